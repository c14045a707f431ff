"""What can go wrong that a caller should know: each kind with the code that answers carry."""

from __future__ import annotations


class GazetteError(ValueError):
    """An error that is part of an answer."""

    code = "error"

    def details(self) -> dict:
        """Fields of the answer besides the message."""
        return {}


class InvalidIdentifier(GazetteError):
    """Not an identifier, or one of another kind than is needed."""

    code = "invalid_identifier"


class InvalidTerms(GazetteError):
    """A query that can't be answered: unknown keys, modes, or text that folds to nothing."""

    code = "invalid_terms"


class InvalidSearch(GazetteError):
    """Arguments of a search that can't be answered."""

    code = "invalid_search"


class InvalidCursor(GazetteError):
    """A cursor outside the document."""

    code = "invalid_cursor"


class InvalidRequest(GazetteError):
    """A request that asks for nothing, or for something that can't be."""

    code = "invalid_request"


class InvalidAddress(InvalidRequest):
    """An address that isn't one of the old portal's PDFs."""

    code = "invalid_address"


class Ambiguous(InvalidRequest):
    """A key that names several records; ``candidates`` are their ids."""

    code = "ambiguous"

    def __init__(self, key: str, candidates: list):
        super().__init__(f"{key} names {len(candidates)} records")
        self.candidates = candidates

    def details(self) -> dict:
        return {"candidates": self.candidates}


class NotFound(GazetteError):
    """What was asked for isn't there."""

    code = "not_found"

    def __init__(self, message: str, **more):
        super().__init__(message)
        self.more = more

    def details(self) -> dict:
        return self.more


class UnreadablePage(GazetteError):
    """A page without what makes it one of its kind."""

    code = "unreadable_page"


class BadDownload(GazetteError):
    """Content that isn't what was asked for."""

    code = "bad_download"


class TooLarge(BadDownload):
    """Content beyond the limit of size."""

    code = "too_large"


class SiteClosed(GazetteError):
    """The site's guard is shut: it blocks us, or its budget of errors is used up."""

    def __init__(self, message: str, seconds: float, blocked: bool):
        super().__init__(message)
        self.code, self.seconds = "site_blocked" if blocked else "preventive_pause", seconds

    def details(self) -> dict:
        return {"retry_after_seconds": self.seconds}


class StorageError(GazetteError):
    """A store that can't be read or written."""

    code = "storage_error"


class NoIndex(StorageError):
    """There is no index yet."""

    code = "index_unavailable"


class OtherVersion(NoIndex):
    """The index was written by another version."""

    code = "index_version"
