"""Kinds of errors that callers may tell apart."""

from __future__ import annotations


class ExpectedFile(ValueError):
    """A folder stands where a file is needed."""


class ExpectedFolder(ValueError):
    """A file, or nothing, stands where a folder is needed."""


class UnexpectedLink(ValueError):
    """A symbolic link stands where a file is needed."""


class InvalidHashPath(ValueError):
    """A target that isn't bucket-subbucket-digest."""


class NotAnArchive(ValueError):
    """A path without the archives' extension."""


class IdNotFound(KeyError):
    """No row of the registry has the id."""


class OutOfRange(IndexError):
    """No row of the table has the position."""


class ArchiveLocked(RuntimeError):
    """Another process repairs the archive."""


class InsufficientSpace(RuntimeError):
    """A repair needs more free space than there is."""
