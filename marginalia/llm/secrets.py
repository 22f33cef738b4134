"""Secret scans with corpus-wide ownership frequency.

Texts are scanned once for spans of fixed rules (base kinds) and for candidates of further kinds. The
hash of every value is then counted over the corpus by distinct owners and repositories: first within
each owner, then across, so that a value that a third of all texts hold is combined where it is read.
A value that several owners have is an example that was copied around; a value of one owner that looks
random is reported as live. Only ids, places and hashes are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import checkpointed, sliced

#: Base kinds, in the order that breaks ties; fixed values.
BASE = ("assign", "access", "hex")
#: Further kinds, after the base ones.
MORE = ("jwt", "pem", "bearer", "url", "prefix")
KINDS = BASE + MORE

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32}")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Further rules: what a text must hold, and the pattern whose last group, or whole match, is the value.
#: Each begins where a run of its characters begins, or at a literal, so that no run is tried from every place in it.
_RULES = {
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "pem": ("-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}?-----END [A-Z ]*PRIVATE KEY-----")),
    "bearer": ("earer ", re.compile(r"\b[Bb]earer ([A-Za-z0-9+/_.=~-]{20,})")),
    "url": ("://", re.compile(r"(?<=[A-Za-z0-9+.-])://[^\s/:@]+:([^\s/:@]{6,})@")),
    "prefix": ("_", re.compile(r"\b(?:gh[pousr]|sk_live|rk_live|glpat|xox[abprs])[_-][A-Za-z0-9_-]{16,}")),
}


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the base rules, matches of each rule leftmost and not overlapping."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), "assign", m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _LONG_HEX.search(text):
        found += [(m.start(), "hex", m.end(), m[0]) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return found


def more_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the further rules."""
    found = []
    for kind, (need, rule) in _RULES.items():
        if need in text:
            for m in rule.finditer(text):
                if kind == "url" and not _SCHEME.search(text, max(0, m.start() - 32), m.start()):
                    continue
                g = m.re.groups
                found.append((m.start(g), kind, m.end(g), m[g]))
    return found


def looks_random(value: str, bits: float = 3.0, share: float = 0.85) -> bool:
    """Whether the characters of a value vary as those of a key do.

    They have bits of entropy each, or in a short value this share of what its length allows, and are
    of two classes at least.
    """
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit))
    return entropy >= min(bits, share * math.log2(len(value))) and classes >= 2


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied_by: int = 2, by_text: bool = False) -> DataFrame:
    """One row a document: its id, and found, an array of structs in order of start, then kind.

    A struct has kind, start, end (code points, end exclusive), owners and repos (how many of each
    have the value in the corpus), base (whether a base rule found it) and verdict: "copied" for a
    value that copied_by owners or more have, else "live" if it looks random, else "weak". A span of
    a further kind is left out if it is copied or weak; spans of the base rules all stay.

    With by_text, copies of one text are of one owner, the first in order, when owners are counted towards
    copied_by: a document that is copied whole makes its keys no examples, while a snippet that texts of
    many owners hold is one, whatever stands around it. The column owners counts them all.

    A null or empty text has none. A null owner is an owner of its own, as is a null repository. Rows
    that repeat are scanned each; they are one repository if they agree in repo_col.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out, texts = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text) + more_spans(text)
                out.append([{"start": a, "kind": KINDS.index(k), "end": z, "hash": hashlib.blake2b(v.encode(), digest_size=16).digest(), "random": looks_random(v)} for a, k, z, v in spans])
                texts.append(hashlib.blake2b(text.encode(), digest_size=16).digest() if by_text and spans else None)
            spans = pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.binary()), ("random", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("owner"), batch.column("repo"), spans, pa.array(texts, pa.binary())], names=["id", "owner", "repo", "spans", "whole"])

    one = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), one(owner_col).alias("owner"), one(repo_col).alias("repo"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    scanned = source.mapInArrow(run, f"id {kind}, owner string, repo string, spans array<struct<start:bigint,kind:int,end:bigint,hash:binary,random:boolean>>, whole binary")
    scanned = checkpointed(scanned.withColumn("row", F.monotonically_increasing_id()))
    each = scanned.filter(F.size("spans") > 0).select("row", "owner", "repo", "whole", F.explode("spans").alias("s")).select("row", "owner", "repo", "whole", "s.*")
    held = (
        each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    )
    if by_text:
        places = each.groupBy("hash", "whole").agg(F.min("owner").alias("owner")).groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("users"))
        held = held.join(places, "hash")
    else:
        held = held.withColumn("users", F.col("owners"))
    verdict = F.when(F.col("users") >= copied_by, "copied").when(F.col("random"), "live").otherwise("weak")
    base = F.col("kind") < len(BASE)
    judged = each.join(held, "hash").withColumn("verdict", verdict).filter(base | (F.col("verdict") == "live"))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "verdict"))).alias("found"))
    found = F.transform(F.coalesce("found", F.array()), lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["owners"].alias("owners"), s["repos"].alias("repos"),
        (s["kind"] < len(BASE)).alias("base"), s["verdict"].alias("verdict")))
    return scanned.select("row", "id").join(spans, "row", "left").select(F.col("id").alias(id_col), found.alias("found"))


def told(found, where=None):
    """kind:start:end of the spans (of those for which where holds), joined by commas."""
    spans = F.filter(found, where) if where else found
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
