"""Secrets: base patterns, and a token-efficiency test for random strings.

Base kinds are assign, access and hex. Beyond them, each long run of the characters that keys are written in
is encoded with a public byte-pair vocabulary: words of any language compress to several characters per token,
random strings hardly do. A run of fewer than ``max_ratio`` characters per token becomes a span of kind
``random``, unless it is a known form of digest (pure hexadecimal), a UUID or a number, touches a base span, or is made of
words: parts between separators, digits and capitals that are cheap in tokens themselves make up most of it. A run is judged
as a whole, whatever its length; the encoder sees it in pieces, which adds less than a token for each of them.

Defined cases: a null text is empty and has no spans; the digest of no spans is that of an empty string; rows are judged
one by one, so repeated rows, null ids and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from engramite.llm.common import doc_id, map_batches, texts_of

KINDS = ("assign", "access", "hex", "random")
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint"

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_SIGN = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:sha\d*[-:=])?(?:[0-9a-fA-F]+|0x[0-9a-fA-F]+)")
_UUID = re.compile(r"[{]?[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}[}]?")
_NUMBER = re.compile(r"[0-9+/_=-]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
MAX_RATIO, WORD_RATIO = 2.1, 2.5
_PIECE = 4096  # characters that are encoded at once


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind. A match that fails its length is dropped without a retry."""
    spans = []
    if _SIGN.search(text):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(spans)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def known_form(s: str) -> bool:
    """Digests, UUIDs and numbers: not secrets by themselves."""
    return bool(_DIGEST.fullmatch(s) or _UUID.fullmatch(s) or _NUMBER.fullmatch(s))


def made_of_words(s: str, encoding) -> bool:
    """Whether parts that the vocabulary knows as words, in lower case, make up most of it. Length alone makes no word."""
    words = (p for p in _PART.findall(s) if len(p) >= 4 and p.isalpha())
    return sum(len(p) for p in words if len(p) >= WORD_RATIO * token_count(p.lower(), encoding)) >= 0.6 * len(s)


def token_count(s: str, encoding) -> int:
    return sum(len(encoding.encode_ordinary(s[i : i + _PIECE])) for i in range(0, len(s), _PIECE))


def merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans, which come by start."""
    starts, ends = [], []
    for _, a, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def load_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def random_runs(text: str, base: list[tuple[str, int, int]], encoding, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """Spans of random runs that touch no base span. base: by start."""
    found, (starts, ends) = [], merged(base)
    for m in _CANDIDATE.finditer(text):
        s, at = m[0], bisect_left(starts, m.end()) - 1  # the last base span that starts before the run ends
        if known_form(s) or (at >= 0 and ends[at] > m.start()):
            continue
        if len(s) < max_ratio * token_count(s, encoding) and not made_of_words(s, encoding):
            found.append(("random", *m.span()))
    return found


def find(text: str, encoding) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = detect(text)
    return base, random_runs(text, base, encoding)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def default_vocabulary() -> tuple[str, str]:
    """File and split pattern of the public vocabulary that is installed with the tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def find_secrets(documents: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and how many the method added.

    vocabulary: path and split pattern, valid on the executors; None: the installed public one."""

    def make():
        encoding = load_encoding(*(vocabulary or default_vocabulary()))

        def work(batch: pa.RecordBatch) -> dict:
            out = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")}
            for text in texts_of(batch):
                base, added = find(text, encoding)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(ordered(base + added)))
                out["n_added"].append(len(added))
            return out | {"doc_id": batch.column("doc_id")}

        return work

    return map_batches(documents.select(doc_id(documents).alias("doc_id"), documents["text"]), make, SCHEMA)
