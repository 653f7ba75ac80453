"""Typed errors. Anything outside the declared shapes is refused with one of these, never approximated."""


class QuillError(Exception):
    """Base of all errors of this library."""


class UnsupportedShape(QuillError):
    """A query shape the executors do not run."""


class CatalogMismatch(QuillError):
    """Tables that are not those of the bound catalogs."""


class RelationMismatch(QuillError):
    """A relation type that no supplied table has."""


class InvalidRelationSchema(QuillError):
    """A relation that is not binary between non-null entities."""


class InvalidIdentity(QuillError):
    """A value that is not a typed identifier of the wanted kind."""


class InvalidTable(QuillError):
    """Rows or columns that break a table's contract."""


class ResourceLimit(QuillError):
    """A declared budget that the input or result passes."""


class BindingError(QuillError):
    """A query that does not belong to the snapshot, or that the engine profile cannot run."""


class SchemaMismatch(QuillError):
    """A batch whose schema is not exactly the declared one."""


class ContentError(QuillError):
    """Blocks that are missing, too large or not what their identifier says."""


class NotFound(ContentError):
    """A block that a store does not hold."""


class ManifestError(QuillError):
    """A snapshot manifest that is not canonical or not consistent."""


class TransferError(QuillError):
    """A transfer session that is over its budget, late or cancelled."""


class OutboxError(QuillError):
    """Outbox records that are malformed, drifted or over capacity."""


class ParseError(QuillError):
    """Query text outside the accepted grammar, or that is not the text that was named."""
