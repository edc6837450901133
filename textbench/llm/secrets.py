"""Secret scans with corpus-wide ownership frequency.

Patterns give candidate values. Their hashes are counted by distinct texts (each
text counts once, however often it is copied) and by distinct owners: a value that
several owners have is a widely copied example; one that a single owner has and that
looks random is a live-looking credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.words import known_id, with_missing_ids
from textbench.session import materialize

# fixed values: kinds and patterns of the base, in the order of the contract
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
# between the runs of base64 of a key: spaces, quoting and escaped line ends
_GAP = r"""(?:[\s"',>#*|]|\\[nrt])"""
#: A key up to its END line; without one, its header lines and the runs of base64 that follow.
PRIVATE_KEY = re.compile(
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    r"(?:([^-]*(?:-(?!----)[^-]*)*)-----END [A-Z ]{0,30}PRIVATE KEY-----"
    rf"|((?:{_GAP}*(?:Proc-Type|DEK-Info|Comment|Version):[^\n\\]*(?:\n|\\n))*(?:{_GAP}*[A-Za-z0-9+/]{{16,}}={{0,2}})*"
    rf"(?:{_GAP}+(?:[A-Za-z0-9+/]+={{1,2}}|(?=[A-Za-z]*[0-9+/])[A-Za-z0-9+/]+))?))"
)
_GAPS = re.compile(_GAP + "+")
# patterns of this operator: (kind, what must be in the text, pattern, group with the value)
MORE = [
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    ("forge_token", "_", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{30,}"), 0),
    ("chat_token", "xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0),
    ("map_key", "AIza", re.compile(r"AIza[A-Za-z0-9_-]{30,}"), 0),
    ("pay_key", "_live_", re.compile(r"(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{16,}"), 0),
    ("url_login", "://", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:([^\s/:@]{4,200})@"), 1),
    ("bearer", "earer", re.compile(r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]{16,})"), 1),
]
KINDS = [*BASE, "private_key", *(kind for kind, *_ in MORE)]
MIN_VALUE = 6
#: Owners, and repositories, from which on a value counts as widely copied.
MANY_OWNERS = 5
#: Bits per character from which on a value looks random.
RANDOM_BITS = 2.5
PLACEHOLDER = re.compile(r"(?i)x{4,}|\.{3,}|example|changeme|your[_-]|dummy|sample|placeholder|^(.)\1*$")

FOUND = "doc_id bigint, text_hash bigint, owner string, repository string, spans array<struct<kind:string,start:int,end:int,value:string,random:boolean>>"
_HEX_RUN = re.compile(rb"h{24}")
_AS_HEX = bytes(0x68 if i in b"0123456789abcdef" else 0x20 for i in range(256))


def bits(value: str) -> float:
    """Entropy per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; code points, ends exclusive.

    A match spans all of the pattern; leftmost, non-overlapping within a kind.
    """
    out = []
    lower = text.lower()
    if any(word in lower for word in ("passw", "secret", "token", "api_key", "apikey")):
        out += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text)]
    if _HEX_RUN.search(text.encode("utf-8", "surrogatepass").translate(_AS_HEX)):
        out += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:  # the value is the key without its line ends, so that one key is one value
        out += [("private_key", *m.span(), _GAPS.sub("", m[1] if m[1] is not None else m[2])) for m in PRIVATE_KEY.finditer(text)]
    for kind, needed, pattern, group in MORE:
        if needed in text:
            out += [(kind, *m.span(), m[group]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find(documents: DataFrame, owner: str = "source", repository: str | None = None) -> DataFrame:
    """Per row: doc_id, text_hash, owner, repository and its spans; values as hashes. Without
    a column for it a distinct text is a repository of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [
                [
                    (kind, a, b, hashlib.sha256(v.encode()).hexdigest()[:32], bits(v) >= RANDOM_BITS and not PLACEHOLDER.search(v))
                    for kind, a, b, v in scan(text)
                ]
                for text in batch["text"]
            ]
            names = ("kind", "start", "end", "value", "random")
            out = batch[["doc_id", "text_hash", "owner", "repository"]].copy()
            out["spans"] = [[dict(zip(names, s, strict=True)) for s in row] for row in spans]
            yield out

    text = F.coalesce("text", F.lit(""))
    place = F.col(repository) if repository else F.xxhash64(text)
    rows = documents.select(
        known_id(F.col("doc_id")),
        F.xxhash64(text).alias("text_hash"),
        F.col(owner).cast("string").alias("owner"),
        place.cast("string").alias("repository"),
        text.alias("text"),
    )
    return with_missing_ids(rows.mapInPandas(run, FOUND))


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_texts, n_repositories, n_owners) of each candidate value over the whole corpus.

    A distinct text gives one owner, however many sources copy it: if some owner has all
    texts of a value it is the only one, else each text counts for its least owner.
    Counted in steps that combine before each shuffle, so neither an owner with a third
    of the rows nor a value that many rows have is gathered in one task.
    """
    seen = found.select("text_hash", "owner", "repository", F.explode("spans.value").alias("value")).distinct()
    values = seen.select("text_hash", "owner", "value").distinct()
    places = seen.filter("repository is not null").select("value", "repository").distinct()
    places = places.groupBy("value").agg(F.count(F.lit(1)).alias("n_repositories"))
    texts = values.select("value", "text_hash").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_texts"))
    owned = values.filter("owner is not null")
    first = owned.groupBy("value", "text_hash").agg(F.min("owner").alias("owner"))
    first = first.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    first = first.groupBy("value").agg(F.sum("n").alias("n_owned"), F.count(F.lit(1)).alias("n_first"))
    most = owned.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.max("n").alias("most"))
    one = F.when(F.col("most") == F.col("n_owned"), F.lit(1)).otherwise(F.col("n_first"))
    owners = first.join(most, "value").select("value", one.cast("bigint").alias("n_owners"))
    joined = texts.join(places, "value", "left").join(owners, "value", "left")
    counted = (F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_repositories", "n_owners"))
    return joined.select("value", "n_texts", *counted)


def judge(
    documents: DataFrame, owner: str = "source", repository: str | None = None, many_owners: int = MANY_OWNERS
) -> DataFrame:
    """Per row of ``documents``: doc_id, text_hash, spans with a verdict each.

    ``verdict`` is 'copied' for values that at least ``many_owners`` owners have, in as
    many repositories, or in as many distinct texts where no column names them; 'live' for
    other random-looking values, however many rows of a few owners hold them; and 'weak'
    for the rest. Rows without an owner or a repository add none. NULL and empty texts
    have no spans, long ones are scanned whole; repeated rows stay; other columns are
    ignored; an empty table gives no rows.
    """
    found = materialize(find(documents, owner, repository))
    values = found.select(F.explode("spans").alias("s")).select("s.value", "s.random").distinct()
    copied = F.least("n_owners", "n_repositories") >= many_owners
    verdict = (
        F.when(copied, "copied").when(F.col("random"), "live").otherwise("weak")
    )
    verdicts = values.join(ownership(found), "value").select("value", verdict.alias("verdict"), "n_texts", "n_owners")
    keys = ["doc_id", "text_hash"]
    asked = found.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.*").distinct()
    told = asked.join(verdicts, "value").groupBy(*keys)
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    told = told.agg(
        F.array_sort(
            F.collect_list(F.struct("start", F.element_at(order, F.col("kind")).alias("rank"), "end", "kind", "verdict", "n_owners", "n_texts"))
        ).alias("spans")
    )
    rows = found.select(*keys)
    same = rows["doc_id"].eqNullSafe(told["doc_id"]) & (rows["text_hash"] == told["text_hash"])
    none = F.array().cast(told.schema["spans"].dataType)
    return rows.join(told, same, "left").select(rows["doc_id"], rows["text_hash"], F.coalesce("spans", none).alias("spans"))


def redact(
    documents: DataFrame,
    owner: str = "source",
    mark: str = "<secret>",
    repository: str | None = None,
    many_owners: int = MANY_OWNERS,
) -> DataFrame:
    """``documents`` with every span replaced by ``mark``, unless its value is widely copied.

    ``n_chars`` follows the text; other columns and clean rows stay as they are; an empty
    table stays empty.
    """
    spans = judge(documents, owner, repository, many_owners)
    live = spans.select("doc_id", "text_hash", F.filter("spans", lambda s: s["verdict"] != "copied").alias("spans"))
    live = live.filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    live = live.select(F.col("doc_id").alias("live_id"), F.col("text_hash").alias("live_hash"), F.col("spans").alias("live"))
    # one struct holds the row, so that no name of its columns can clash
    rows = documents.select(
        F.struct(*(documents[c] for c in documents.columns)).alias("row"),
        F.xxhash64(F.coalesce(documents["text"], F.lit(""))).alias("row_hash"),
    )
    same = F.col("row")["doc_id"].cast("bigint").eqNullSafe(F.col("live_id")) & (F.col("row_hash") == F.col("live_hash"))
    text = F.col("row")["text"]
    # overlapping spans become one mark
    cut = F.aggregate(
        "live",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("reach")),
        lambda a, s: F.struct(
            F.when(
                s["start"] >= a["reach"],
                F.concat(a["done"], F.substring(text, a["reach"] + 1, s["start"] - a["reach"]), F.lit(mark)),
            )
            .otherwise(a["done"])
            .alias("done"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
        lambda a: F.concat(a["done"], F.substring(text, a["reach"] + 1, F.length(text))),
    )
    out = rows.join(live.hint("merge"), same, "left").select("row", F.coalesce(cut, text).alias("new_text"))
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("bigint")}
    own = lambda c: F.when(F.col("new_text").eqNullSafe(text), F.col("row")[c]).otherwise(new[c]) if c in new else F.col("row")[c]
    return out.select(*(own(c).alias(c) for c in documents.columns))


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    printed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    with_verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return out.select(
        "doc_id",
        *(n(kind) for kind in BASE),
        F.sha2(printed(base).cast("binary"), 256).alias("base_sha256"),
        printed(F.col("spans")).alias("spans"),
        with_verdict("live").alias("n_live"),
        with_verdict("copied").alias("n_copied"),
    )
