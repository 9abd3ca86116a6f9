"""Secret scanning with an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger remembers which (blob, rule version) pairs have been
scanned and what was found; an update scans only pairs it has not seen, and findings are joined back to every path that
has the blob. Rules are regular expressions; spans count code points, end exclusive.

The ledger is two Parquet tables. An update writes its findings first and then its list of scanned pairs, both under
the same run; findings of a run without such a list are not read, so an update that dies half way is just repeated.

A null text is the empty text. Repeated rows share a blob and each get its findings. An empty table updates nothing.
Positions come from the lengths of the pieces between matches, and only blobs with a match leave the scan.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayrate.llm.common import packed, unpacked


@dataclass(frozen=True)
class Rule:
    """All leftmost, non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


_BASE64 = "[A-Za-z0-9+/]"

# The base rules as given, then public formats of well-known credentials.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # with its body: up to the END line, over single hyphens of header lines; without one, the base64 lines that follow
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,12}-----END [A-Z ]{0,40}PRIVATE KEY-----"
                rf"|(?:[ \t]*[\r\n]+[ \t]*{_BASE64 * 16}+={{0,2}}){{0,200}}(?:[ \t]*[\r\n]+[ \t]*{_BASE64}+={{1,2}})?)", version=2),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE
SCANNED = "sha string, kind string, version int, run string"
FOUND = "sha string, kind string, version int, start long, end long, run string"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _matches(text: Column, rule: Rule) -> Column:
    """Lengths around every match: text before it since the last one, the match, its group."""
    sizes = lambda strings: F.transform(strings, F.length)
    pattern, parts = F.lit(rule.pattern), [F.split(text, rule.pattern, -1)]
    parts += [F.regexp_extract_all(text, pattern, F.lit(g)) for g in (0, rule.group)]
    zipped = F.arrays_zip(*[sizes(p).alias(n) for p, n in zip(parts, ("gap", "size", "value"))])
    return F.when(text.rlike(rule.pattern), zipped)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(sha, kind, version, start, end) of blobs (sha, text, todo): ``todo`` lists the kinds wanted for the blob."""
    found = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                 F.when(F.array_contains("todo", r.kind), _matches(F.col("text"), r)).alias("matches"))
        for r in rules
    ]
    hits = blobs.select("sha", F.explode(F.filter(F.array(*found), lambda f: f["matches"].isNotNull())).alias("f"))
    each = hits.select("sha", "f.kind", "f.version", "f.least", F.posexplode("f.matches").alias("i", "m"))
    upto = Window.partitionBy("sha", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(upto)
    spans = each.withColumn("end", end).where(F.col("m.value") >= F.col("least"))
    return spans.select("sha", "kind", "version", (F.col("end") - F.col("m.size")).alias("start"), "end")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _same_rules(rules: tuple[Rule, ...]) -> Column:
    return reduce(Column.__or__, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])


def update(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scan what the ledger folder has not seen yet of the texts in ``versions`` and write it there."""
    spark, run = versions.sparkSession, uuid.uuid4().hex
    texts = versions.select(address(F.col(text_col)).alias("sha"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    new = _unseen(texts.select("sha").distinct(), ledger, rules)
    blobs = texts.dropDuplicates(["sha"])
    if _exists(spark, f"{ledger}/scanned"):
        blobs = blobs.join(new, "sha")
    else:
        blobs = blobs.withColumn("todo", _kinds(rules))
    scan(blobs, rules).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{ledger}/findings")
    versions_of = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    new.select("sha", F.explode("todo").alias("kind")).select(
        "sha", "kind", versions_of[F.col("kind")].alias("version"), F.lit(run).alias("run")
    ).write.mode("append").parquet(f"{ledger}/scanned")


def _kinds(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(r.kind) for r in rules])


def _unseen(shas: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(sha, todo): kinds whose present version has not been tried on the blob."""
    scanned = _read(shas.sparkSession, f"{ledger}/scanned", SCANNED).where(_same_rules(rules))
    seen = scanned.groupBy("sha").agg(F.collect_set("kind").alias("seen"))
    todo = F.array_except(_kinds(rules), F.coalesce("seen", F.array().cast("array<string>")))
    return shas.join(seen, "sha", "left").select("sha", todo.alias("todo")).where(F.size("todo") > 0)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(sha, spans) of every blob with findings of these rule versions: spans by start, then rule order."""
    done = _read(spark, f"{ledger}/scanned", SCANNED).where(_same_rules(rules)).select("run").distinct()
    rows = _read(spark, f"{ledger}/findings", FOUND).where(_same_rules(rules)).join(done, "run", "left_semi")
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    span = F.struct("start", order[F.col("kind")].alias("place"), "kind", "end")
    return rows.groupBy("sha").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def joined_back(versions: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """``versions`` plus ``spans`` (in place of such a column): the findings of the blob at every path, or an empty list."""
    kind = found.schema["spans"].dataType.simpleString()
    rows = packed(versions, text_col).withColumn("sha", address(F.col(text_col)))
    back = rows.join(found, "sha", "left").withColumn("spans", F.coalesce("spans", F.array().cast(kind)))
    return unpacked(back, [*[c for c in versions.columns if c != "spans"], "spans"], text_col, "spans")


def written(spans: Column, kinds: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    wanted = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in kinds]))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by ``[kind]`` of the first."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        mark = F.concat(F.lit("["), s["kind"], F.lit("]"))
        before = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(before, mark)).alias("out"))
        within = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(within)

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"].cast("int") + 1, 2**31 - 1))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))
