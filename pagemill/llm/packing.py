"""Cost-balanced packing: documents cut and packed into sequences of equal estimated attention cost.

A document of L tokens costs LINEAR * L + L^2 / context: the linear part for the layers, the quadratic one for
attention within the document. Each task tokenizes its documents and, as soon as it holds GROUP tokens, packs these:
in descending order each goes to the sequence of lowest cost that still has room for it. So nothing is shuffled, a
task's memory is bounded by the group, and a lost task is repeated without touching the sequences of others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, text_batches

CONTEXT, END, LINEAR = 4096, 2, 1.0
GROUP = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost double"


#: Over this plain part of Latin-1 the vocabulary's own normalising (NFC, lower case) and splitting come to PIECE on lower case.
PLAIN = re.compile("[\t\n\r -~\xa1-\xac\xae-\xff]*")
PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe\\s]+")


class Encoder:
    """Token ids of texts. Words of plain texts are encoded once each and up to `keep` of them kept; any text with
    other characters, or that may hold a special token, goes to the tokenizer whole."""

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.keep, self.words = Tokenizer.from_file(path), keep, {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(33, 256)) if PLAIN.fullmatch(c)}

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        words, known = PIECE.findall(text.lower()), self.words
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), dtype="<u4")
        except KeyError:
            new = set(words)
        if len(known) > self.keep:
            known.clear()
        tokenize, level = self.tokenizer.model.tokenize, self.bytes
        for w in new:
            if w not in known:
                known[w] = np.array([t.id for t in tokenize(w.translate(level))], dtype="<u4").tobytes()
        return np.frombuffer(b"".join([known[w] for w in words]), dtype="<u4")


def cost(n, context: int = CONTEXT):
    return LINEAR * n + n * n / context


def plan(lengths: np.ndarray, context: int = CONTEXT) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a group; sequence k holds capacities(sum, context)[k] tokens, all full."""
    room = np.array(capacities(int(lengths.sum()), context), dtype="i8")
    full = room.copy()
    load, out, todo = np.zeros(len(room)), [], []

    def put(doc: int, start: int, n: int, k: int) -> None:
        out.append((doc, start, n, k, int(full[k] - room[k])))
        room[k] -= n
        load[k] += cost(n)

    for doc, n in enumerate(lengths.tolist()):
        start = 0
        while n - start > context:  # longer than a sequence: cut
            todo.append((context, doc, start))
            start += context
        if n > start:
            todo.append((n - start, doc, start))
    for n, doc, start in sorted(todo, key=lambda x: (-x[0], x[1], x[2])):
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(doc, start, n, int(fits[np.argmin(load[fits])]))
            continue
        while n:  # no sequence has room for all of it: fill the roomiest
            k = int(np.argmax(room))
            part = min(n, int(room[k]))
            put(doc, start, part, k)
            start, n = start + part, n - part
    return out


def capacities(total: int, context: int = CONTEXT) -> list[int]:
    """Full sequences, then powers of two for what is left: none needs padding."""
    left = total % context
    return [context] * (total // context) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, tokenizer: str, context: int = CONTEXT, end: int = END, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """A row per piece of every row of docs(doc_id, text): SCHEMA, and the ids themselves if asked for.

    A null or empty text is the single id `end`. Repeated rows are packed each. Sequence ids hold the partition in
    their upper bits. An empty table gives no rows.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, number = Encoder(tokenizer), TaskContext.get().partitionId() << 36, 0

        def out(names: list, ids: list) -> pd.DataFrame:
            nonlocal number
            pieces = plan(np.array([len(x) for x in ids], dtype="i8"), context)
            rows = [(names[d], s, n, zlib.crc32(ids[d][s : s + n].tobytes()), len(ids[d]), part + number + k, o) for d, s, n, k, o in pieces]
            pdf = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            pdf["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
            pdf["sequence_tokens"] = pdf.groupby("sequence_id")["length"].transform("sum")
            pdf["cost"] = cost(pdf["length"].astype("f8"), context)
            if with_ids:
                pdf["ids"] = [ids[d][s : s + n].astype("i8").tolist() for d, s, n, _, _ in pieces]
            number += max(k for _, _, _, k, _ in pieces) + 1
            return pdf

        names, ids, held = [], [], 0
        for pdf in batches:
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                x = np.append(encoder.ids(t), np.uint32(end)).astype("<u4")
                names.append(None if pd.isna(d) else int(d))
                ids.append(x)
                held += len(x)
                if held >= group:
                    yield out(names, ids)
                    names, ids, held = [], [], 0
        if ids:
            yield out(names, ids)

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(packed, SCHEMA + (", ids array<long>" if with_ids else ""))


def tokenizer_path() -> str:
    """Where the workers find the vocabulary: the installed folder of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: pack() of the whole table documents; odd rows as defined there."""
    return pack(load(spark, sf_dir, "documents"), tokenizer_path())
