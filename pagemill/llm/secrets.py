"""Secret scans: fixed patterns, and strings that cost many tokens for their length under a public vocabulary.

Words and names of any language are merged into few tokens; random strings are not. So a long run of key characters
with few characters per token is suspect, unless it is a known digest or an identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, text_batches

#: The patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

_LONG = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
_WORDY = re.compile(r"(?a:password|passwd|secret|token|api_?key)", re.I)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_SRI = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+=*")
#: The shape of an identifier: parts of letters of one case or Capitalised, joined by _ - / or written together, with a number at most at an end.
#: Every part is a maximal run that is never given back, so a match takes linear time.
_IDENTIFIER = re.compile(r"(?:[_/=-]++|[A-Z]?+[a-z]{2,}+|[A-Z]{2,}+)++[0-9]{0,6}+[_/=-]*+|[\d_/=+-]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def excluded(s: str, path: str, ratio: float = 2.0) -> bool:
    """Whether s is a known digest or an identifier: its shape, and parts that cost as few tokens as words do."""
    if any(p.fullmatch(s) for p in (_DIGEST, _UUID, _SRI)):
        return True
    if not _IDENTIFIER.fullmatch(s):
        return False
    parts = _PART.findall(s)
    return sum(map(len, parts)) >= ratio * sum(len(x) for x in _encoding(path).encode_ordinary_batch(parts, num_threads=1))


def spans(text: str | None, path: str, ratio: float = 2.0, known: frozenset = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in code points, by start, then kind as listed; "random" ones touch no others and are not known."""
    text, out = text or "", []
    if (":" in text or "=" in text) and _WORDY.search(text):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = list(_LONG.finditer(text))
    for m in runs:
        out += [(*x.span(), "access") for x in ACCESS.finditer(text, *m.span()) if len(x[0]) >= 20]
        out += [(*x.span(), "hex") for x in HEX.finditer(text, *m.span())]
    base = sorted(out)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    for m in runs:
        for x in _RUN.finditer(text, *m.span()):
            s, (a, b) = x[0], x.span()
            before = bisect_left(starts, b)  # base spans that start before the run's end: touched if one of them ends after its start
            if len(set(s)) < 8 or (before and reach[before - 1] > a) or s in known or excluded(s, path, ratio):
                continue
            if len(s) / len(_encoding(path).encode_ordinary(s)) < ratio:
                out.append((a, b, "random"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, vocabulary: str, ratio: float = 2.0, text: str = "text", known: frozenset = frozenset()) -> DataFrame:
    """docs with `found`, an array of (start, end, kind); empty for null and empty texts. known: strings that are no secrets, beside digests and identifiers.

    Rows are scanned each, repeated ones too; a column `found` is replaced; an empty table gives none.
    """
    text_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in spans(x, vocabulary, ratio, known)] for x in t], dtype=object)

    return docs.withColumn("found", of(F.col(text)))


def redact(docs: DataFrame, vocabulary: str, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of `text` replaced by a mark (overlapping spans by one); other texts, null ones too, stay as they are.

    Every row stays, repeated ones too, with all its columns; an empty table gives none.
    """
    text_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                at, parts = 0, []
                for a, b, _ in spans(t, vocabulary):
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]) if parts else t)
            yield pd.Series(out, dtype=object)

    return docs.withColumn("text", of(F.col("text")))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, counts of base kinds, base_sha256, spans) of every row of docs(doc_id, text).

    Null and empty texts have none of each kind and the digest of an empty list; a null doc_id stays null; repeated rows
    are scanned each; an empty table gives none.
    """
    text_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                found = [(k, f"{k}:{a}:{b}") for a, b, k in spans(t, vocabulary)]
                base = ",".join(x for k, x in found if k != "random")
                out.append((*(sum(k == kind for k, _ in found) for kind in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in found)))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"]).assign(doc_id=pd.array(pdf["doc_id"], dtype="Int64"))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op9: digest() of the whole table documents; odd rows as defined there."""
    return digest(load(spark, sf_dir, "documents"), vocabulary_path())
