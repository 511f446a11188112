"""Token counts attributed to sections of documents that are encoded whole."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A published byte-level BPE vocabulary as ranks, and its pre-tokenisation pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str):
    """The encoding, and the length in bytes of each token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The section of each token [start, end), where section i is [bounds[i], bounds[i+1]).

    A token inside a section belongs to it. One that crosses boundaries goes to the section that
    holds most of its bytes, and of equals to the first.
    """
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    out = first.copy()
    for i in np.flatnonzero(first != last):
        parts = np.arange(first[i], last[i] + 1)
        held = np.minimum(bounds[parts + 1], ends[i]) - np.maximum(bounds[parts], starts[i])
        out[i] = parts[held.argmax()]
    return out


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) -> a row for each section: doc_id, section, start, end (code points), tokens.

    Sections are the text's lines, each with the line feed that ends it; so they cover the text and
    their counts add up to the whole text's. The text is encoded once, as a whole; the tokens' byte
    spans follow from their lengths and are joined to the sections by `attribute`. Null and empty
    texts have one section from 0 to 0 with no tokens. Repeated rows are repeated. Special tokens'
    names are ordinary text. The vocabulary file has to be at `vocabulary` on every executor.
    """

    def count(batches):
        enc, sizes = encoding(vocabulary)
        for batch in batches:
            ids, section, begin, end, tokens = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
                feeds = np.flatnonzero(raw == 10) + 1
                bounds = np.concatenate(([0], feeds[feeds < len(raw)], [len(raw)]))
                k = len(bounds) - 1
                ends = np.cumsum(sizes[np.asarray(enc.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                tokens.append(np.bincount(attribute(starts, ends, bounds), minlength=k) if len(ends) else np.zeros(k, np.int64))
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[bounds]
                ids.append(np.full(k, i))
                section.append(np.arange(k))
                begin.append(points[:-1])
                end.append(points[1:])
            if ids:
                whole = [np.concatenate(x).astype(np.int64) for x in (ids, section, begin, end, tokens)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whole[0])), *map(pa.array, whole[1:])], names=["doc_id", "section", "start", "end", "tokens"])

    schema = docs.select("doc_id").schema
    for c in ("section", "start", "end", "tokens"):
        schema = schema.add(c, "long")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
