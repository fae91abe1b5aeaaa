"""Identities: content hashes, owner-salted ids, name-based UUIDs; and vector arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: the URL namespace of name-based UUIDs
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
LIBRARY = "library"


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def document_id(owner: Column, file_hash: Column) -> Column:
    """The hash itself in the shared library, salted with the owner elsewhere."""
    return F.when(owner == LIBRARY, file_hash).otherwise(F.sha2(F.concat(F.lit("user:"), owner, F.lit(":"), file_hash), 256))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """A name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def point_id(document: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat_ws(":", document, chunk_index.cast("string")))


def owner_for(path: Column, root: str) -> Column:
    """The owner whose folder holds a path; null outside all of them."""
    found = F.regexp_extract(path, rf"^{root}/users/([^/]+)/.+", 1)
    return F.when(found == "", F.lit(None).cast("string")).otherwise(found)


def within(path: Column, folder: Column) -> Column:
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalised(v: Column) -> Column:
    """A vector of unit length."""

    def divided(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
        return _once(norm, lambda n: F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12))))

    return _once(v, divided)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value named, as the one element of an array, so that it is computed once and not at every place of use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash_embedding(text: Column, dimension: int) -> Column:
    """A deterministic stand-in for a model: repeated digest bytes, of unit length."""

    def bytes_of(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)

    return normalised(_once(F.sha2(text, 256), bytes_of))


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a reranker: the share of the query's characters found in the text."""
    chars = F.filter(F.split(query, ""), lambda c: c != "")
    found = F.size(F.filter(chars, lambda c: text.contains(c)))
    return F.when(F.size(chars) > 0, found / F.size(chars)).otherwise(F.lit(0.0))
