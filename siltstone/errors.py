"""The one exception of the library, with an error class and named fields."""

from __future__ import annotations


class SiltstoneError(Exception):
    """``error_class`` is one of ERROR_CLASSES; ``fields`` has what belongs to it."""

    def __init__(self, error_class: str, **fields: object):
        if error_class not in ERROR_CLASSES:
            raise ValueError(f"unknown error class {error_class}")
        self.error_class, self.fields = error_class, fields
        super().__init__(ERROR_CLASSES[error_class].format(**fields))

    def __reduce__(self):
        return _rebuild, (self.error_class, self.fields)


def _rebuild(error_class: str, fields: dict) -> SiltstoneError:
    return SiltstoneError(error_class, **fields)


ERROR_CLASSES = {
    "IO": "cannot read: {details}",
    "MISSING_ATTRIBUTE": "missing required attribute: {name}",
    "CORRUPT_RECORD": "corrupt record {number}",
    "INVALID_RECORD": "invalid record at byte position {position}",
    "INVALID_DATA_RUN": "invalid data run: {details}",
    "ALLOCATION_TOO_LARGE": "allocation of {size} bytes exceeds the address space",
    "INVALID_GEOMETRY": "invalid volume geometry: {details}",
    "INVALID_OPTION": "invalid option: {details}",
}
