"""Token counts of sections, attributed by character offsets.

A document is encoded once and whole. Its tokens have character spans; so have its sections. The spans are joined as
intervals, and each token is allotted to exactly one section:

    a token that crosses a boundary goes to the section that holds most of its characters; of equals, to the first.

So the counts of the sections add up to the count of the document, which counting each section alone would miss.

The vocabulary is byte-level: a token's span in bytes follows from the lengths of the tokens before it, without
decoding. A character split over several tokens lies in the span of each of them.

Edge cases: a null or empty text has one section of length 0 and no token; an empty section has none either; repeated
rows give repeated rows; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import map_arrow, slices, utf8

COLUMNS = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
_loaded: dict[str, tuple] = {}


def encoding(path: str) -> tuple:
    """(encoder, bytes of each id) of a ranks file; loaded once in a worker."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _loaded[path]


def line_ends(raw: bytes) -> np.ndarray:
    """Ends, in characters, of the lines of a text; a line break belongs to the line that it ends."""
    if not raw:
        return np.zeros(1, np.int64)
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b == 10) + 1
    if not len(ends) or ends[-1] != len(b):
        ends = np.append(ends, len(b))
    return np.cumsum((b & 0xC0) != 0x80)[ends - 1]


def sentence_ends(raw: bytes) -> np.ndarray:
    """Ends, in characters, of the sentences of a text: after white space that follows ``.``, ``!`` or ``?`` or holds a
    line break. The white space belongs to the sentence that it ends, so a token that begins with it crosses over."""
    if not raw:
        return np.zeros(1, np.int64)
    b = np.frombuffer(raw, np.uint8)
    solid = np.flatnonzero(~((b == 32) | ((b >= 9) & (b <= 13))))
    p, q = solid[:-1], solid[1:]
    wide = np.flatnonzero(q > p + 1)
    p, q = p[wide], q[wide]
    breaks = np.cumsum(b == 10)
    at = q[np.isin(b[p], (33, 46, 63)) | (breaks[q] > breaks[p])]
    return np.cumsum((b & 0xC0) != 0x80)[np.append(at, len(b)) - 1]


def attribute(raw: bytes, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a boundary) allotted to each section; ``ends`` are the sections' ends in characters."""
    own, crossing = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    if not len(ids):
        return own, crossing
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1  # of each byte
    stop = np.cumsum(sizes[ids])
    start, last = char[stop - sizes[ids]], char[stop - 1]
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, last, "right")
    top = len(ends) - 1  # characters beyond the last end count to the last section
    a, b = np.minimum(a, top), np.minimum(b, top)
    two = np.flatnonzero(b == a + 1)  # over one boundary: to the second part only if it's the larger
    later = last[two] + 1 - ends[a[two]] > ends[a[two]] - start[two]
    many = np.flatnonzero(b > a + 1)
    a = a.copy()
    a[two] += later
    crossing += np.bincount(a[two], minlength=len(ends))
    for t in many.tolist():
        edges = np.clip(np.concatenate(([start[t]], ends[a[t] : b[t]], [last[t] + 1])), start[t], last[t] + 1)
        a[t] += int(np.argmax(np.diff(edges)))
        crossing[a[t]] += 1
    return np.bincount(a, minlength=len(ends)), crossing


def section_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", ends: Column | None = None, split: Callable[[bytes], np.ndarray] = line_ends) -> DataFrame:
    """One row for each section: doc_id, section (from 0), char_start, char_end, n_tokens, n_crossing (of them, those
    that cross a boundary) and doc_tokens. Sections end at ``ends`` (ascending character offsets, the last the text's
    length), for example the cumulated lengths of concatenated fields, or where ``split`` cuts a text: by default each
    line is one."""
    chosen = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text).alias("t"), (F.lit(None) if ends is None else ends).cast("array<bigint>").alias("e"))

    by_text = ends is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoding(path)
        for b in slices(batches, "t", 8 << 20):
            parts = []
            given = [None] * b.num_rows if by_text else b.column("e").to_pylist()
            for raw, e in zip(utf8(b.column("t")), given, strict=True):
                raw = raw or b""
                ids = enc.encode_to_numpy(raw.decode(), disallowed_special=()) if raw else np.zeros(0, np.uint32)
                e = np.array(e, np.int64) if e else split(raw)
                own, crossing = attribute(raw, ids, sizes, e)
                parts.append((e, own, crossing, len(ids)))
            n = np.array([len(p[0]) for p in parts], np.int64)
            if not len(n):
                continue
            row = np.repeat(np.arange(len(n)), n)
            end = np.concatenate([p[0] for p in parts])
            section = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = np.where(section == 0, 0, np.concatenate(([0], end[:-1])))
            yield pa.RecordBatch.from_arrays(
                [b.column("i").take(pa.array(row)), pa.array(section.astype(np.int32)), pa.array(start), pa.array(end),
                 pa.array(np.concatenate([p[1] for p in parts])), pa.array(np.concatenate([p[2] for p in parts])), pa.array(np.array([p[3] for p in parts], np.int64)[row])],
                ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"],
            )

    return map_arrow(chosen, run, COLUMNS)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The counts of every sentence of every document."""
    return section_counts(docs, path or default_path(), split=sentence_ends)
