"""Column builders: keys and JSON values."""

from .keys import canonical_key, key_of
from .values import checksum, document, label_of, member, numeric, score, textual_score

__all__ = ["canonical_key", "checksum", "document", "key_of", "label_of", "member", "numeric", "score", "textual_score"]
