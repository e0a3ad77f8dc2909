"""Secret scans with corpus-wide ownership.

Patterns find candidates in whole texts. The hashes of all candidates' values are
aggregated over the corpus by the distinct repositories and owners that hold them: a
value in many owners' files is a copied example, one that few owners hold and that
looks random is a live-looking credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, map_arrow, spans, strings, tune

#: A value that so many owners hold is an example, whatever it looks like.
EXAMPLE_OWNERS = 3
#: Bits a character that a live-looking value has at least.
RANDOM_BITS = 2.5

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Kinds that the scan adds to the base ones.
MORE = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    # From a run's first eyJ: if that has no match, a later one of the run has none.
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "payment": re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}"),
    "private_key": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
}
KINDS = ["assign", "access", "hex", *MORE]
_WORDS = ["password", "passwd", "secret", "token", "api"]
_MARKS = "AKIA|gh[pousr]_|eyJ|xox[abprs]-|AIza|k_live_|PRIVATE KEY-----"
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True


def find_secrets(text: str) -> list[tuple[int, int, int, str]]:
    """(start, index of kind, end, value), ascending; ends are exclusive code points."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    for k, pattern in enumerate(MORE.values(), 3):
        out += [(m.start(pattern.groups), k, m.end(), m[pattern.groups]) for m in pattern.finditer(text)]
    return sorted(out)


def _random(value: str) -> bool:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= RANDOM_BITS


def _suspects(texts: pa.Array) -> np.ndarray:
    """Which texts can hold a secret at all, by scans at memory speed."""
    data, offsets = strings(texts)
    # Not pc.ascii_lower, which garbles the cast of a slice: its first offset isn't 0.
    whole, low = (pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(x)) for x in (data, LOWER[data]))
    some = pc.match_substring_regex(whole, _MARKS)
    for word in _WORDS:
        some = pc.or_(some, pc.match_substring(low, word))
    out = some.to_numpy(zero_copy_only=False).copy()
    starts, ends, row = spans(_HEX_BYTE[data], offsets)
    out[row[ends - starts >= 24]] = True
    return out


_NONE = hashlib.sha256(b"").hexdigest()


def _scanned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, 200):
        part = batch.slice(a, 200)
        texts = part.column("text").cast(pa.large_string()).fill_null("")
        rows = []
        for text, some in zip(texts, _suspects(texts)):
            found = find_secrets(text.as_py()) if some else []
            names = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found]
            kinds = Counter(k for _, k, _, _ in found)
            base = ",".join(x for x, f in zip(names, found) if f[1] < 3)
            values = [{"h": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "at": i, "random": _random(v)} for i, (_, _, _, v) in enumerate(found)]
            rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(base.encode()).hexdigest() if base else _NONE, ",".join(names), values))
        cols = list(zip(*rows))
        kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("random", pa.bool_())]))
        arrays = [part.column("doc_id").cast(pa.int64()), part.column("repo"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3]), pa.array(cols[4], pa.string()), pa.array(cols[5], kind)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])


def secret_scan(docs: DataFrame, repo: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live_spans.

    ``spans`` has all finds as kind:start:end; ``live_spans`` those held by fewer than
    ``example_owners`` owners and random enough; n_example counts values of at least so
    many. A repository's owner is its name up to the first slash. Null text counts as
    empty; a null repository is one more owner of its own name. Overlapping finds of
    several kinds all count. Repeated rows repeat. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"))
    kinds = "doc_id long, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<h: long, at: int, random: boolean>>"
    scanned = scratch.keep(map_arrow(docs, _scanned, kinds).withColumn("uid", F.monotonically_increasing_id()))
    each = scanned.where(F.size("found") > 0).select("uid", "repo", F.explode("found").alias("x")).select("uid", "repo", "x.*")
    # A value of a third of all rows is one row per repository and task before anything is shuffled.
    held = each.select("h", "repo").distinct().withColumn("owner", F.substring_index("repo", "/", 1))
    owners = held.groupBy("h", "owner").agg(F.count("*").alias("repos")).groupBy("h").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))
    judged = each.join(owners, "h")
    judged = judged.groupBy("uid").agg(
        F.count_if((F.col("owners") < example_owners) & F.col("random")).alias("n_live"),
        F.count_if(F.col("owners") >= example_owners).alias("n_example"),
        F.max("repos").alias("most_repositories"),
        F.sort_array(F.collect_list(F.when((F.col("owners") < example_owners) & F.col("random"), F.col("at")))).alias("live"),
    )
    out = scanned.join(judged, "uid", "left")
    live = F.coalesce(F.array_join(F.transform("live", lambda i: F.element_at(F.split("spans", ","), i + 1)), ","), F.lit(""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", zero("n_live"), zero("n_example"), zero("most_repositories"), live.alias("live_spans"))
