"""Secret scans with a ledger of blobs, in DataFrame functions only.

A text is stored under its content address (SHA-256), whatever the number of paths and versions
that hold it. A scan compares the addresses with the ledger of (blob, rule, version) and reads
only texts with an unseen pair; findings are kept by blob and joined back to all paths.

Texts are scanned and masked where they lie: bitmaps of a bit a row tell which to scan, a filter of
the addresses with findings which may need a mask, and only the latter shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh_column, materialise, stage_path, text_or_empty
from .exact_dedup import BLOCK_POSITIONS, MAX_FILTER_BYTES, filter_blocks, is_set, possibly_repeated, repeated_positions


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` (Java syntax); those whose ``group`` has fewer than
    ``least`` characters are dropped. ``hint`` is a cheap pattern every text with a match also matches."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


# Fixed values. Runs of the last two classes are maximal, so a length in the pattern
# drops the same matches as a later test would, and spares the short ones.
RULES = (
    Rule(
        "assign", 1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, r"(?i)(?:passw|secret|token|api_?key)",
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points, end exclusive, in order; empty for no match.

    The pieces between matches and the matches themselves alternate, so running lengths give the
    positions.
    """
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    lengths = F.arrays_zip(
        F.slice(gaps, 1, F.size(whole)).alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("len"),
        F.transform(checked, lambda m: F.length(m)).alias("part"),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["len"]
        found = F.when(
            m["part"] >= rule.least,
            F.concat(acc["found"], F.array(F.struct(begin.alias("start"), end.alias("end")))),
        ).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.when(text.rlike(rule.hint), F.aggregate(lengths, start, step, lambda acc: acc["found"])).otherwise(empty)


class SecretLedger:
    """The ledger's tables under ``path`` (a folder all executors share).

    ``seen``: blob, kind, version; ``findings``: blob, kind, version, start, end. Both only grow,
    findings first, so a scan that broke off is repeated and readers drop what it wrote twice.
    """

    SEEN = "blob string, kind string, version int"
    FINDINGS = "blob string, kind string, version int, start int, end int"

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as err:
            if "PATH_NOT_FOUND" in str(err):
                return self.spark.createDataFrame([], schema)
            raise

    def unseen(self, blobs: DataFrame) -> DataFrame:
        """blob with ``todo``, the kinds whose current version has not scanned it; seen blobs are left out."""
        current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in self.rules])
        pairs = blobs.select("blob", F.explode(current).alias("r")).select("blob", "r.kind", "r.version")
        seen = self._read("seen", self.SEEN)
        fresh = pairs.join(seen, ["blob", "kind", "version"], "left_anti")
        return fresh.groupBy("blob").agg(F.collect_set("kind").alias("todo"))  # at most one entry a rule

    def scan(self, df: DataFrame, *, path_cols: list[str], text_col: str = "text") -> DataFrame:
        """Scan what is unseen of ``df`` and return every row's findings.

        Each row is one version of a path. Columns: ``path_cols``, ``blob`` and ``found``, an array of (start, kind_no, kind, end) ordered by start, then rule; empty
        where nothing is found. A null text counts as empty. Repeated rows and equal texts are
        one blob and all get its findings. An empty table gives no rows.
        """
        text = text_or_empty(text_col)
        staged = materialise(
            df.select(
                *[F.col(c).alias(f"path_{i}") for i, c in enumerate(path_cols)], F.sha2(text, 256).alias("blob"), text.alias("content"),
            ),
            "versions",
        )
        self._scan_new(staged)
        return self.joined_back(staged.drop("content"), path_cols)

    def _scan_new(self, contents: DataFrame) -> None:
        """Scan the unseen pairs of a stage table of ``blob, content`` and record them."""
        rows = contents.select("blob", "content", F.monotonically_increasing_id().alias("row"))
        blobs = rows.groupBy("blob").agg(F.min("row").alias("row"))  # the row to read a blob's text from
        todo = materialise(blobs.join(self.unseen(blobs), "blob").select("row", "todo"), "todo")
        texts = self._with_todo(rows, todo)

        def of(rule: Rule) -> Column:
            named = F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")
            each = F.transform(
                spans(F.col("content"), rule), lambda s: F.struct(*named, s["start"].alias("start"), s["end"].alias("end"))
            )
            none = F.array().cast("array<struct<kind:string,version:int,start:int,end:int>>")
            return F.when(F.array_contains("todo", rule.kind), each).otherwise(none)

        found = F.concat(*map(of, self.rules))
        scanned = materialise(texts.select("blob", "todo", found.alias("found")), "scanned")
        found_rows = scanned.select("blob", F.explode("found").alias("f")).select("blob", "f.*")
        found_rows.write.mode("append").parquet(f"{self.path}/findings")
        versions = F.create_map(*[x for r in self.rules for x in (F.lit(r.kind), F.lit(r.version))])
        seen_rows = scanned.select("blob", F.explode("todo").alias("kind"))
        seen_rows.withColumn("version", versions[F.col("kind")]).write.mode("append").parquet(f"{self.path}/seen")

    def _with_todo(self, rows: DataFrame, todo: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
        """The ``rows`` that ``todo`` names, with their kinds, by a broadcast bitmap a rule and block of row numbers; beyond ``max_bytes`` by a shuffle."""
        block, place = F.shiftright("row", 15).alias("block"), F.col("row").bitwiseAND(BLOCK_POSITIONS - 1)
        marks = todo.groupBy(block).agg(*[
            F.bitmap_construct_agg(F.when(F.array_contains("todo", r.kind), place)).alias(f"bits_{i}") for i, r in enumerate(self.rules)
        ])
        marks = materialise(marks, "marks")
        if marks.count() * len(self.rules) * BLOCK_POSITIONS // 8 > max_bytes:
            return rows.join(todo.hint("shuffle_hash"), "row")
        kinds = F.array_compact(F.array(*[F.when(is_set(F.col(f"bits_{i}"), place), F.lit(r.kind)) for i, r in enumerate(self.rules)]))
        joined = rows.withColumn("block", block).join(F.broadcast(marks), "block")
        return joined.select("blob", "content", "row", kinds.alias("todo")).where(F.size("todo") > 0)

    def mask(self, df: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
        """``df`` with its secrets replaced by ``mask``: only texts of blobs with findings are changed, and shuffled.

        Null texts stay null. A row in, a row out, with the columns of ``df``.
        """
        blob, found, flag = (fresh_column(df.columns, n) for n in ("blob", "found", "flag"))
        staged = materialise(df.withColumn(blob, F.sha2(text_or_empty(text_col), 256)), "addressed")
        self._scan_new(staged.select(F.col(blob).alias("blob"), text_or_empty(text_col).alias("content")))
        spans_of = materialise(self._by_blob().select(F.col("blob").alias(blob), F.col("found").alias(found)), "spans")
        blocks = filter_blocks(spans_of.count())
        marked = materialise(repeated_positions(spans_of, blob, blocks, 1), "filter")
        flagged = possibly_repeated(staged, blob, marked, blocks, flag)
        text = F.col(text_col)
        clean = F.when(text.isNotNull() & F.col(found).isNotNull(), redacted(text, F.col(found), mask)).otherwise(text)
        masked = flagged.where(flag).join(spans_of, blob, "left").withColumn(text_col, clean)
        return flagged.where(~F.col(flag)).select(*df.columns).union(masked.select(*df.columns))

    def findings(self) -> DataFrame:
        """Findings of the current rule versions, each once."""
        current = F.lit(False)
        order = F.lit(None).cast("int")
        for i, r in enumerate(self.rules):
            current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
            order = F.when(F.col("kind") == r.kind, F.lit(i)).otherwise(order)
        return self._read("findings", self.FINDINGS).where(current).distinct().withColumn("kind_no", order)

    def _by_blob(self) -> DataFrame:
        return self.findings().groupBy("blob").agg(
            F.sort_array(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("found")  # one text's findings
        )

    def joined_back(self, versions: DataFrame, path_cols: list[str]) -> DataFrame:
        none = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>")
        return versions.join(self._by_blob(), "blob", "left").select(
            *[F.col(f"path_{i}").alias(c) for i, c in enumerate(path_cols)], "blob", F.coalesce("found", none).alias("found")
        )


def new_ledger(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> SecretLedger:
    """An empty ledger in the session's shared folder."""
    return SecretLedger(spark, stage_path(spark, "ledger"), rules)


def redacted(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each finding replaced by ``mask``; findings that overlap the one before share its mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        apart = f["start"] >= acc["at"]
        between = F.substring(text, acc["at"] + 1, f["start"] - acc["at"])
        out = F.when(apart, F.concat(acc["out"], between, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], f["end"]).alias("at"), out.alias("out"))

    return F.aggregate(
        found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"]))
    )
