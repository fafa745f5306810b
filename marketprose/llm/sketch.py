"""Document fingerprints: every shingle hash below a fixed fraction of the hash space is retained.

Such a sketch grows with its text, so the retained hashes of two texts of very unequal length still show what part of
the short one the long one holds; and the sketch of two texts together is the union of their sketches.
A shingle is ``SIZE`` code points; the text is padded at both ends, so that the shortest texts have shingles too.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from marketprose.llm.common import as_key, frames, keyed, mixed, ordered_buckets, walked

SIZE = 16  # a power of two
BITS = 48  # of a hash
SCALED = 16  # one of so many hashes is retained

_BASE = np.uint64(0x100000001B3)


def shingle_values(text: str) -> np.ndarray:
    """48-bit hashes of all padded shingles of the text; none for an empty text."""
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    value = np.zeros(len(points) + 2 * (SIZE - 1), np.uint64)
    value[SIZE - 1 : len(value) - SIZE + 1] = points
    value = mixed(value)
    width, factor = 1, _BASE
    with np.errstate(over="ignore"):
        while width < SIZE:  # windows of twice the width from two neighbours
            value = value[:-width] * factor + value[width:]
            factor = factor * factor
            width *= 2
    return mixed(value) >> np.uint64(64 - BITS)


def sketch(text: str, scaled: int = SCALED) -> np.ndarray:
    """Sorted distinct hashes below the fraction 1 / ``scaled``."""
    values = shingle_values(text)
    return np.unique(values[values < np.uint64((1 << BITS) // scaled)])


def merged(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of several texts taken together."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]))


def containment(part: np.ndarray, whole: np.ndarray) -> float:
    """Estimated share of the shingles of ``part`` that ``whole`` has; 0 if nothing of ``part`` was retained."""
    return len(np.intersect1d(part, whole, assume_unique=True)) / len(part) if len(part) else 0.0


def to_string(text: str, values: np.ndarray) -> str:
    """A fingerprint: digest of the text, a dot, and eight base64 characters per retained hash."""
    packed = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return f"{xxhash.xxh3_64_hexdigest(text)}.{base64.b64encode(packed).decode()}"


def from_string(fingerprint: str) -> np.ndarray:
    """The retained hashes of a fingerprint."""
    raw = np.frombuffer(base64.b64decode(fingerprint.partition(".")[2]), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").ravel().astype(np.uint64)


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints: the two containments, each weighted with the size of its sketch.

    Equal fingerprints give 1; sketches of texts so short that nothing was retained give 0 otherwise.
    """
    if a == b:
        return 1.0
    x, y = from_string(a), from_string(b)
    total = len(x) + len(y)
    return (containment(x, y) * len(x) + containment(y, x) * len(y)) / total if total else 0.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", scaled: int = SCALED) -> DataFrame:
    """Per row: key, n_chars, n_hashes, fingerprint. Null texts count as empty; equal texts have equal fingerprints."""
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sketch(t, scaled) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "n_chars": batch["text"].map(len),
                "n_hashes": [len(s) for s in found],
                "fingerprint": [to_string(t, s) for t, s in zip(batch["text"], found, strict=True)],
            })

    found = rows.mapInPandas(run, "doc_id string, n_chars bigint, n_hashes bigint, fingerprint string")
    return keyed(found, kind=dict(docs.dtypes)[key])


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points, rounded down, replaced by the first as many of another text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter] if quarter else text


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", scaled: int = SCALED) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document's text, and their likeness.

    Documents follow each other by ascending key, equal keys by text, null keys first; after the last comes the one
    with the smallest key. Null texts count as empty. Where no document has a key the last one is followed by an empty
    text. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited (share of the text's shingles that the edited text keeps).
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = walked(ordered_buckets(rows, "doc_id", wrap=True), "doc_id", "text")
    placed = placed.select("bucket", "lead", as_key("doc_id").alias("doc_id"), "text")

    def compared(doc: str | None, own: str, following: str) -> tuple:
        edited = edited_text(own, following)
        values = sketch(own, scaled)
        changed = values if edited == own else sketch(edited, scaled)
        mark, edited_mark = to_string(own, values), to_string(edited, changed)
        next_mark = to_string(following, sketch(following, scaled))
        return (
            doc, len(own), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark,
            likeness(mark, edited_mark), likeness(mark, next_mark), containment(values, changed),
        )

    columns = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next contained_edited".split()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str | None, str] | None = None
        bucket = None
        for of, found in frames(batches):
            out = []
            if of != bucket:
                if held is not None:
                    out.append(compared(*held, ""))
                held, bucket = None, of
            for doc, own, lead in zip(found["doc_id"], found["text"], found["lead"], strict=True):
                if held is not None:
                    out.append(compared(*held, own))
                held = None if lead else (doc, own)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held is not None:
            yield pd.DataFrame([compared(*held, "")], columns=columns)

    schema = (
        "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, contained_edited double"
    )
    return keyed(placed.mapInPandas(run, schema))
