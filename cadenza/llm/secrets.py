"""Secret scan: keyword automaton, anchored expressions at its hits, checksums within the finds.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over the lower-cased text. Only at a hit is that
kind's expression tried, at that place. Finds that carry a checksum or have a structure are then validated.
Runs of hexadecimal digits have no keyword: their character class is its own filter.

Kinds, in order: assign, access and hex (the base), then github and npm (36 characters after the prefix, the last six
the base-62 CRC-32 of the others), jwt (its header must decode to an object with "alg") and pem (private key blocks).
Finds of one kind do not overlap; the leftmost counts. Offsets are code points, end exclusive. Of a run of base64url
characters only the first `eyJ` can begin a jwt, and where no end follows a key block's head, none is looked for again
before the run of characters that may stand in a block is over: so the time grows with the text's length alone.

Defined results: a null text is empty and has no spans; a head that is no JSON object (or nested too deeply to be read as
one) makes no jwt; rows that repeat a doc_id are scanned each; an empty table gives an empty result. A task holds one
Arrow batch of texts.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import in_arrow, sub_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "pem")

_FOLD = {c: c + 32 for c in range(65, 91)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    """The CRC-32 of body as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = _BASE62[d] + digits
    return digits


def _checked(match: re.Match) -> bool:
    body = match[1]
    return crc_base62(body[:-6]) == body[-6:]


def _is_jwt(match: re.Match) -> bool:
    head = match[1]
    try:
        said = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error, RecursionError):
        return False
    return isinstance(said, dict) and "alg" in said


#: kind: keywords (lower case), expression, what a find must satisfy; a failed match costs no more than what it has read
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checked),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checked),
}
HEX = re.compile(r"[0-9a-f]{24,}")
_URL_RUN = re.compile(r"[A-Za-z0-9_-]+")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_PEM_HEAD = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_PEM_RUN = re.compile(r"[A-Za-z0-9+/=\s:,-]*")
_PEM_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")


class _Jwt:
    """Tokens of three parts; a head reaches to the end of its run, so of each run the first place is tried, and no other."""

    def at(self, text: str, start: int) -> tuple[int | None, int]:
        """The end of the find that begins at start, or None, and where the next one may begin."""
        if not text.startswith("eyJ", start):
            return None, start
        if m := _JWT.match(text, start):
            return (m.end() if _is_jwt(m) else None), m.end()
        return None, _URL_RUN.match(text, start).end()


class _Pem:
    """Key blocks: from a head to the next end mark, with nothing but characters of a block in between."""

    def __init__(self) -> None:
        self.run_end = -1

    def at(self, text: str, start: int) -> tuple[int | None, int]:
        head = _PEM_HEAD.match(text, start)
        if not head:
            return None, start
        if head.end() > self.run_end:
            self.run_end = _PEM_RUN.match(text, head.end()).end()
        end = _PEM_END.search(text, head.end(), self.run_end)
        return (end.end(), end.end()) if end else (None, self.run_end)


#: Kinds with a rule of their own, and their keywords.
LONG = {"jwt": (("eyj",), _Jwt), "pem": (("-----begin ",), _Pem)}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (keywords, *_) in (RULES | LONG).items():
        for k in keywords:
            out.add_word(k, (kind, len(k)))
    out.make_automaton()
    return out


def find(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """start, kind's number and end of each span, in that order."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: fold A-Z only
        low = text.translate(_FOLD)
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    hits = sorted((end - n + 1, kind) for end, (kind, n) in keywords.iter(low))
    free: dict[str, int] = {}
    rules = {kind: rule() for kind, (_, rule) in LONG.items()}
    for start, kind in hits:
        if start < free.get(kind, 0):
            continue
        if kind in LONG:
            end, free[kind] = rules[kind].at(text, start)
            if end is not None:
                spans.append((start, KINDS.index(kind), end))
            continue
        _, pattern, valid = RULES[kind]
        if m := pattern.match(text, start):
            free[kind] = m.end()
            if valid(m):
                spans.append((start, KINDS.index(kind), m.end()))
    return sorted(spans)


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id and spans, an array of kind, start and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in sub_batches(batches, "text"):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t, keywords)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "spans": pa.array(found, _SPAN_TYPE)})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return in_arrow(rows, run, f"doc_id long, spans {_SPANS}")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
