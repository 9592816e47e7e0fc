
from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tableweave as tw
from tableweave.operators.union import DROP, KEEP_AS_NEW
from tableweave.plans.series_query import SeriesQuery, series_table
from tableweave.session import shared_folder
from tableweave.sources.csvfiles import CsvOptions, read_csv, write_csv

try:  # the training-data operators come and go as one part
    import corpus_pipeline
    from tableweave.llm import queries as llm
except ImportError:
    corpus_pipeline = llm = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --------------------------------------------------------------- shared inputs

# Money in whole cents keeps sums exact, so both engines give equal values.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_cents")


def lines_in_cents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate",
        "l_returnflag",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("l_cents"),
    )


LINES_SQL = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate, l_returnflag,
           CAST(round(l_extendedprice * 100) AS BIGINT) AS l_cents
    FROM lineitem
"""


def events_as_series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_type").alias("tag"),
        F.col("ts").alias("timestamp"),
        F.round(F.col("value") * 100).cast("bigint").alias("value"),
        "event_id",
    )


SERIES_SQL = """
    SELECT event_type AS tag, ts AS timestamp,
           CAST(round(value * 100) AS BIGINT) AS value, event_id
    FROM events
"""


# ------------------------------------------------------------------ equi joins


def _documents_labels(how: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
        return tw.equi_join(docs, table(spark, d, "labels"), ["doc_id"], ["doc_id"], how)

    return run


def _documents_labels_sql(join: str, key: str) -> str:
    return f"""
        SELECT {key} AS doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM documents d {join} JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id
    """


def equi_outer(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    return tw.equi_join(table(spark, d, "labels"), vectors, ["doc_id"], ["vec_id"], "outer")


def equi_composite(spark: SparkSession, d: str) -> DataFrame:
    """Keys repeat on both sides, so this is also the many-to-many case."""
    lines = table(spark, d, "lineitem")
    left = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    right = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    keys = ["l_orderkey", "l_linenumber"]
    return tw.equi_join(left, right, keys, keys, "inner", suffixes=("_l", "_r"))


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"),
        F.col("c_acctbal").alias("balance"),
    )
    right = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("balance"),
        F.col("s_nationkey").alias("nation"),
    )
    return left, right


PEOPLE_SQL = """
    WITH l AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name,
                      c_acctbal AS balance FROM customer),
         r AS (SELECT s_suppkey AS key, s_name AS name,
                      CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS balance,
                      s_nationkey AS nation FROM supplier)
"""


def _conflict(policy: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        left, right = _people(spark, d)
        return tw.equi_join(left, right, ["key"], ["key"], "outer", conflict=policy)

    return run


def unmatched_left(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return tw.unmatched(docs, table(spark, d, "labels"), ["doc_id"], ["doc_id"])


def unmatched_right(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return tw.unmatched(orders, lines, ["o_orderkey"], ["l_orderkey"])


# ------------------------------------------------------------- pre-aggregation

FORMULA = "(sum_vw / (sum_w + 1) + max_v - min_v) * 2 - -mean_w / (count_v + 1)"

PREAGG_SQL = {
    "first": "arg_min(l_cents, {order})",
    "last": "arg_max(l_cents, {order})",
    "sum": "CAST(sum(l_cents) AS BIGINT)",
    "mean": "CAST(sum(l_cents) AS DOUBLE) / count(l_cents)",
    "min": "min(l_cents)",
    "max": "max(l_cents)",
    "count": "count(l_cents)",
    "weighted_sum": "CAST(sum(l_cents * l_quantity) AS DOUBLE)",
    "weighted_mean": "CAST(sum(l_cents * l_quantity) AS DOUBLE) / sum(l_quantity)",
    "formula": """(CAST(sum(l_cents * l_quantity) AS DOUBLE) / (sum(l_quantity) + 1.0::DOUBLE)
        + max(l_cents)::DOUBLE - min(l_cents)::DOUBLE) * 2.0::DOUBLE
        + (sum(l_quantity) / count(l_quantity)) / (count(l_cents)::DOUBLE + 1.0::DOUBLE)""",
}


def _preagg(method: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rule = {"method": method, "formula": FORMULA if method == "formula" else ""}
        lines = tw.pre_aggregate(
            lines_in_cents(spark, d), ["l_orderkey"], {"l_cents": rule}, "l_quantity", LINE_ORDER
        )
        orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
        return tw.equi_join(
            orders, lines, ["o_orderkey"], ["l_orderkey"], "left", right_unique=True
        )

    return run


def _preagg_sql(method: str) -> str:
    order = f"ROW({', '.join(LINE_ORDER)})"
    value = PREAGG_SQL[method].format(order=order)
    return f"""
        SELECT o_orderkey, o_orderdate, a.l_orderkey, a.l_cents
        FROM orders LEFT JOIN (
            SELECT l_orderkey, {value} AS l_cents FROM ({LINES_SQL}) GROUP BY l_orderkey
        ) a ON o_orderkey = a.l_orderkey
    """


# ----------------------------------------------------------------------- as-of


def _asof_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every order, its days brought into the month of the events, against every event.

    Event times are cut to minutes: some are equal, and some orders have the same time.
    """
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("visit_id"),
        F.expr("timestamp_ntz'2024-01-01' + 18 * datediff(o_orderdate, date'1995-01-01') * interval 1 minute").alias("ts"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("status"),
    )
    return orders, table(spark, d, "events").select(
        F.col("event_id").alias("buy_id"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("buy_ts"),
        F.col("user_id").alias("buyer"),
        F.col("value").alias("amount"),
    )


ASOF_LEFT_SQL = """
    SELECT o_orderkey AS visit_id,
           TIMESTAMP '2024-01-01' + INTERVAL 18 MINUTE * date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INTEGER AS ts,
           o_custkey AS user_id, o_orderstatus AS status FROM orders
"""
ASOF_RIGHT_SQL = """
    SELECT event_id AS buy_id, date_trunc('minute', ts)::TIMESTAMP AS buy_ts, user_id AS buyer, value AS amount FROM events
"""


def _one_at_a_time(ahead: bool, by: bool = True) -> str:
    """The right rows, of those at one time the last or, looking ahead, the first."""
    order, part = ("ASC" if ahead else "DESC"), ("buyer, " if by else "")
    return f"""
        SELECT * FROM ({ASOF_RIGHT_SQL})
        QUALIFY row_number() OVER (PARTITION BY {part}buy_ts ORDER BY buy_id {order}) = 1"""


def _asof(by: bool = True, **rules) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        left, right = _asof_tables(spark, d)
        return tw.asof_join(
            left, right, "ts", "buy_ts", ["user_id"] if by else [], ["buyer"] if by else [],
            order_by=["buy_id"], **rules,
        )

    return run


def asof_text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys given as text: both sides turn out to be datetimes."""
    left, right = _asof_tables(spark, d)
    left = left.withColumn("ts", F.col("ts").cast("string"))
    right = right.withColumn("buy_ts", F.col("buy_ts").cast("string"))
    found = tw.asof_join(left, right, "ts", "buy_ts", ["user_id"], ["buyer"], order_by=["buy_id"])
    return found.select("visit_id", "buy_id", "amount")


def _asof_hot(**rules) -> Query:
    """A third of both tables in one by-group."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        left, right = _asof_tables(spark, d)
        left = left.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
        right = right.withColumn("buyer", F.when(F.col("buyer") % 3 == 0, 0).otherwise(F.col("buyer")))
        return tw.asof_join(left, right, "ts", "buy_ts", ["user_id"], ["buyer"], order_by=["buy_id"], **rules)

    return run


def _hot_sql(sql: str) -> str:
    """The query with both by-columns as ``_asof_hot`` has them."""
    left = f"(SELECT visit_id, ts, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, status FROM ({ASOF_LEFT_SQL}))"
    right = f"SELECT buy_id, buy_ts, CASE WHEN buyer % 3 = 0 THEN 0 ELSE buyer END AS buyer, amount FROM ({ASOF_RIGHT_SQL})"
    return sql.replace(f"({ASOF_LEFT_SQL})", left).replace(ASOF_RIGHT_SQL, right)


RIGHT_NAMES = ("buy_id", "buy_ts", "buyer", "amount")


def _asof_sql(compare: str, by: bool = True, where: str = "") -> str:
    on = "l.user_id = r.buyer AND " if by else ""
    shown = [f"CASE WHEN {where} THEN r.{n} END AS {n}" if where else f"r.{n}" for n in RIGHT_NAMES]
    return f"""
        SELECT l.visit_id, l.ts, l.user_id, l.status, {', '.join(shown)}
        FROM ({ASOF_LEFT_SQL}) l ASOF LEFT JOIN ({_one_at_a_time('<' in compare, by)}) r ON {on} l.ts {compare} r.buy_ts
    """


def _nearest_sql(by: bool) -> str:
    on = "l.user_id = {0}.buyer AND " if by else ""
    ahead = "f.buy_ts IS NOT NULL AND (b.buy_ts IS NULL OR f.buy_ts - l.ts < l.ts - b.buy_ts)"
    shown = ", ".join(f"CASE WHEN {ahead} THEN f.{n} ELSE b.{n} END AS {n}" for n in RIGHT_NAMES)
    return f"""
        SELECT l.visit_id, l.ts, l.user_id, l.status, {shown}
        FROM ({ASOF_LEFT_SQL}) l
        ASOF LEFT JOIN ({_one_at_a_time(False, by)}) b ON {on.format('b')} l.ts >= b.buy_ts
        ASOF LEFT JOIN ({_one_at_a_time(True, by)}) f ON {on.format('f')} l.ts <= f.buy_ts
    """


def asof_unmatched_left(spark: SparkSession, d: str) -> DataFrame:
    left, right = _asof_tables(spark, d)
    return tw.asof_unmatched_left(
        tw.asof_matches(left, right, "ts", "buy_ts", ["user_id"], ["buyer"], tolerance="12h")
    )


def asof_unmatched_right(spark: SparkSession, d: str) -> DataFrame:
    left, right = _asof_tables(spark, d)
    return tw.asof_unmatched_right(
        tw.asof_matches(
            left, right, "ts", "buy_ts", ["user_id"], ["buyer"], tolerance="12h", allow_exact=False
        )
    )


# ----------------------------------------------------------------------- union


def _union_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    right = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("bigint").alias("nation"),
        F.col("s_acctbal").alias("balance"),
    )
    return left, right


def union_mapped(spark: SparkSession, d: str) -> DataFrame:
    left, right = _union_tables(spark, d)
    return tw.union_mapped(left, right, {"supplier_id": "id"})


def union_drop_new(spark: SparkSession, d: str) -> DataFrame:
    """A new column that clashes, a dropped one, and numbers meeting text."""
    left, right = _union_tables(spark, d)
    mapping = {"supplier_id": "segment", "name": KEEP_AS_NEW, "balance": DROP}
    return tw.union_mapped(left, right, mapping)


def union_source(spark: SparkSession, d: str) -> DataFrame:
    left, right = _union_tables(spark, d)
    return tw.union_mapped(
        left, right, {"supplier_id": "id"}, source_column="origin", source_value="supplier"
    )


# --------------------------------------------------------------------- reports

REPORT_COLUMNS = [
    "join_type", "left_rows", "right_rows", "output_rows", "matched_left_rows",
    "unmatched_left_rows", "matched_right_rows", "unmatched_right_rows", "left_match_rate",
    "right_match_rate", "left_duplicate_key_rows", "right_duplicate_key_rows",
    "many_to_many_suspected", "row_growth_ratio_vs_left", "algorithm",
]


def _shown(report: DataFrame) -> DataFrame:
    return report.select(*REPORT_COLUMNS, F.array_join("warnings", ",").alias("warnings"))


def _report_equi(how: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _shown(tw.equi_report(
            table(spark, d, "orders"), table(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"],
            how, growth_limit=3.5,
        ))

    return run


def report_many_to_many(spark: SparkSession, d: str) -> DataFrame:
    return _shown(tw.equi_report(
        table(spark, d, "customer"), table(spark, d, "supplier"), ["c_nationkey"], ["s_nationkey"],
        "inner", growth_limit=3.0,
    ))


def report_asof(spark: SparkSession, d: str) -> DataFrame:
    left, right = _asof_tables(spark, d)
    found = tw.asof_matches(left, right, "ts", "buy_ts", ["user_id"], ["buyer"], tolerance="12h")
    return _shown(tw.asof_report(left, right, found, "backward", "12h"))


def report_union(spark: SparkSession, d: str) -> DataFrame:
    left, right = _union_tables(spark, d)
    layout = tw.union_layout(left.columns, right.columns, {"supplier_id": "id"})
    report = tw.union_report(left, right, layout)
    return report.select(
        *REPORT_COLUMNS, F.array_join("warnings", ",").alias("warnings"),
        F.get_json_object("details", "$.mapped_columns").cast("bigint").alias("mapped"),
        F.get_json_object("details", "$.kept_new_columns").cast("bigint").alias("kept_new"),
    )


def _report_sql(
    figures: str, join_type: str, output: str, algorithm: str, limit: float,
    warning: str = "", extra: str = "",
) -> str:
    return f"""
        WITH f AS ({figures}),
             g AS (SELECT *, CAST({output} AS BIGINT) AS output_rows FROM f),
             h AS (SELECT *, ld > 0 AND rd > 0 AND output_rows > greatest(lr, rr) AS m2m,
                          output_rows::DOUBLE / lr AS growth FROM g)
        SELECT '{join_type}' AS join_type, lr AS left_rows, rr AS right_rows, output_rows,
               ml AS matched_left_rows, lr - ml AS unmatched_left_rows,
               mr AS matched_right_rows, rr - mr AS unmatched_right_rows,
               ml::DOUBLE / lr AS left_match_rate, mr::DOUBLE / rr AS right_match_rate,
               ld AS left_duplicate_key_rows, rd AS right_duplicate_key_rows,
               m2m AS many_to_many_suspected, growth AS row_growth_ratio_vs_left,
               '{algorithm}' AS algorithm,
               concat_ws(',', nullif('{warning}', ''), CASE WHEN m2m THEN 'many_to_many' END,
                         CASE WHEN growth > {limit} THEN 'row_growth' END) AS warnings{extra}
        FROM h
    """


def _equi_figures(left: str, right: str, lk: str, rk: str) -> str:
    many = lambda t, k: (
        f"(SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM {t} "
        f"GROUP BY {k}) WHERE c > 1)"
    )
    return f"""
        SELECT (SELECT count(*) FROM {left}) AS lr, (SELECT count(*) FROM {right}) AS rr,
               (SELECT count(*) FROM {left} WHERE {lk} IN (SELECT {rk} FROM {right})) AS ml,
               (SELECT count(*) FROM {right} WHERE {rk} IN (SELECT {lk} FROM {left})) AS mr,
               (SELECT count(*) FROM {left} JOIN {right} ON {lk} = {rk}) AS pairs,
               {many(left, lk)} AS ld, {many(right, rk)} AS rd
    """


# --------------------------------------------------- profile, preparation, pages


def prepare_orders(spark: SparkSession, d: str) -> DataFrame:
    """Rename, project and cast: text to number and datetime, bad values to null."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias(" ｏ_orderkey "),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("custkey"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus"))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"),
        F.date_format("o_orderdate", "yyyy/M/d").alias("day"),
        "o_orderpriority",
    )
    done = tw.prepare(
        orders,
        columns=["o_orderkey", "custkey", "price", "day"],
        types={"custkey": "number", "price": "number", "day": "datetime", "o_orderkey": "string",
               "absent": "number"},
    )
    return done.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def profile_orders(spark: SparkSession, d: str) -> DataFrame:
    return tw.profile(table(spark, d, "orders"))


def infer_types(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumns({
        "user_text": F.col("user_id").cast("string"),
        "day_text": F.date_format("ts", "yyyy-MM-dd HH:mm"),
        "value_text": F.when(F.col("value") < 1, F.lit("low")).otherwise(F.col("value").cast("string")),
    })
    return tw.infer_types(events)


def page_orders(spark: SparkSession, d: str) -> DataFrame:
    return tw.page(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 3, 200)


def page_from_directory(spark: SparkSession, d: str) -> DataFrame:
    """A page from a sorted copy in parts of 500 rows: it spans two of them or lies in one."""
    return tw.page_directory(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], part_rows=500).page(6, 200)


def page_after(spark: SparkSession, d: str) -> DataFrame:
    """The page behind the last row of a page already seen."""
    orders = table(spark, d, "orders")
    return tw.page(
        orders, ["o_orderpriority", "o_orderkey"], size=100, after=["2-HIGH", 500]
    )


def page_count(spark: SparkSession, d: str) -> DataFrame:
    return tw.page_count(table(spark, d, "orders"), 200)


# ----------------------------------------------------------------------- series

ALL_FUNCTIONS = ["average", "min", "max", "sum", "count", "std"]


def ts_recorded(spark: SparkSession, d: str) -> DataFrame:
    return tw.recorded(
        events_as_series(spark, d), "2024-01-03", "2024-01-28 12:00:00", 150, order_by=["event_id"]
    )


def ts_recorded_split(spark: SparkSession, d: str) -> DataFrame:
    """The plan used for large inputs."""
    return tw.recorded(
        events_as_series(spark, d), "2024-01-03", "2024-01-28 12:00:00", 150,
        order_by=["event_id"],
    )


RECORDED_SQL = f"""
    SELECT tag, timestamp, value, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY tag ORDER BY timestamp, event_id) AS n
        FROM ({SERIES_SQL})
        WHERE timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28 12:00:00')
    WHERE n <= 150
"""


def ts_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return tw.snapshot(events_as_series(spark, d), order_by=["event_id"])


def ts_summary(spark: SparkSession, d: str) -> DataFrame:
    """Windows from a fixed start; earlier rows fall into windows before it."""
    long = tw.summarize(
        events_as_series(spark, d), "6h", ALL_FUNCTIONS, "2024-01-05 01:30:00"
    )
    std = F.col("summary") == "std"
    return long.withColumn("value", F.when(std, F.round("value", 4)).otherwise(F.col("value")))


def ts_summary_first(spark: SparkSession, d: str) -> DataFrame:
    """Windows from the first timestamp of each tag."""
    return tw.summarize(events_as_series(spark, d), "1d")


def _summary_sql(anchor: str, micros: int, functions: list[str]) -> str:
    exact = {
        "average": "CAST(sum(value) AS DOUBLE) / count(value)", "min": "min(value)::DOUBLE",
        "max": "max(value)::DOUBLE", "sum": "coalesce(sum(value), 0)::DOUBLE",
        "count": "count(value)::DOUBLE", "std": "round(stddev_samp(value), 4)",
    }
    parts = " UNION ALL ".join(
        f"SELECT tag, w, '{f}' AS summary, {exact[f]} AS value FROM x GROUP BY tag, w"
        for f in functions
    )
    return f"""
        WITH s AS ({SERIES_SQL}),
             a AS (SELECT tag AS atag, {anchor} AS a FROM s GROUP BY tag),
             x AS (SELECT tag, value, a + to_microseconds(CAST(
                       floor((epoch_us(timestamp) - epoch_us(a)) / {micros}::DOUBLE) AS BIGINT)
                       * {micros}) AS w
                   FROM s JOIN a ON tag = atag)
        SELECT tag, w AS window_start, w + to_microseconds({micros}) AS window_end, summary,
               value, 'summary' AS source_type
        FROM ({parts})
    """


def ts_wide(spark: SparkSession, d: str) -> DataFrame:
    """Summary windows of all tags side by side."""
    long = tw.summarize(events_as_series(spark, d), "12h", ["count", "max"], "2024-01-01")
    return tw.to_wide(long)


def ts_interpolated(spark: SparkSession, d: str) -> DataFrame:
    return tw.interpolate(
        events_as_series(spark, d), "2023-12-31 12:00:00", "2024-02-01", "90min",
        order_by=["event_id"],
    )


INTERPOLATED_SQL = f"""
    WITH s AS ({SERIES_SQL}),
         g AS (SELECT tag, unnest(generate_series(TIMESTAMP '2023-12-31 12:00:00',
                   TIMESTAMP '2024-02-01', INTERVAL 90 MINUTE)) AS pit
               FROM (SELECT DISTINCT tag FROM s)),
         j AS (SELECT g.tag, g.pit, p.timestamp AS pt, p.value::DOUBLE AS pv,
                      q.timestamp AS qt, q.value::DOUBLE AS qv
               FROM g ASOF LEFT JOIN s p ON g.tag = p.tag AND g.pit >= p.timestamp
                      ASOF LEFT JOIN s q ON g.tag = q.tag AND g.pit <= q.timestamp)
    SELECT tag, pit AS timestamp,
           CASE WHEN pt = pit THEN pv
                      ELSE pv + (qv - pv) * (epoch_us(pit) - epoch_us(pt))
                           / (epoch_us(qt) - epoch_us(pt)) END AS value,
           'interpolated' AS source_type
    FROM j
"""


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    """Each event opens a frame; frames of sign-ups stay open."""
    events = table(spark, d, "events")
    frames = events.select(
        F.concat(F.lit("EF-"), F.col("event_id").cast("string")).alias("event_frame"),
        F.when(F.col("user_id") % 5 != 0, F.lit("Line ")).otherwise(F.lit("")).alias("template"),
        F.array(F.concat(F.col("event_type"), F.lit(" Watch")), F.lit("Base")).alias("analysis"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("element"),
        F.col("ts").alias("start_time"),
        F.when(
            F.col("event_type") != "signup", F.col("ts") + F.expr("INTERVAL '90' MINUTE")
        ).alias("end_time"),
    )
    return tw.event_frames(
        frames, "ＬＩＮＥ", "2024-01-04", "2024-01-20", ["Error watch", "sign"]
    )


EVENT_FRAMES_SQL = """
    SELECT 'EF-' || event_id AS event_frame,
           CASE WHEN user_id % 5 <> 0 THEN 'Line ' ELSE '' END AS template,
           event_type || ' Watch; Base' AS analysis, 2 AS analysis_count,
           'user ' || user_id AS element, ts AS start_time,
           CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 90 MINUTE END AS end_time,
           CASE WHEN event_type <> 'signup' THEN 5400.0::DOUBLE END AS duration_sec,
           'event_frame' AS source_type
    FROM events
    WHERE ts >= TIMESTAMP '2024-01-04'
      AND (event_type = 'signup' OR ts <= TIMESTAMP '2024-01-20')
      AND event_type IN ('error', 'signup')
"""


def series_query(spark: SparkSession, d: str) -> DataFrame:
    """A historian table as a recipe describes it: summary windows, one column per tag."""
    query = SeriesQuery.from_options("pi_da_tag", {
        "query_type": "Summary", "tags_text": "error、purchase；ｃｌｉｃｋ\nCLICK, view",
        "start_time": "2024-01-02", "end_time": "2024-01-25", "interval": "１２ｈ",
        "summary_functions": ["MAX", "count"],
    })
    return series_table(events_as_series(spark, d), query)


# ------------------------------------------------------------- plans and recipes


def _flagship_plan() -> tw.PlanSpec:
    """Orders, their lines aggregated, their customer, the customer's nation."""
    return tw.PlanSpec("orders", steps=(
        tw.StepSpec(
            "lines", "lineitem", left_keys=("o_orderkey",), right_keys=("l_orderkey",),
            right_pre_agg_enabled=True, right_pre_agg_weight_col="l_quantity",
            right_pre_agg_rules={
                "l_cents": {"method": "weighted_mean"},
                "l_linenumber": {"method": "count"},
                "l_partkey": {"method": "formula", "formula": "count_v + sum_w * 2"},
            },
        ),
        tw.StepSpec("customer", "customer", left_keys=("o_custkey",), right_keys=("c_custkey",)),
        tw.StepSpec("nation", "nation", left_keys=("c_nationkey",), right_keys=("n_nationkey",)),
    ))


def _flagship_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        "lineitem": lines_in_cents(spark, d),
        "customer": table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"),
        "nation": table(spark, d, "nation").select("n_nationkey", "n_name"),
    }


def plan_three_steps(spark: SparkSession, d: str) -> DataFrame:
    return tw.run_plan(_flagship_tables(spark, d), _flagship_plan()).output


PLAN_SQL = f"""
    SELECT o_orderkey, o_custkey, o_totalprice, a.l_orderkey, a.l_cents, a.l_linenumber,
           a.l_partkey, c_custkey, c_name, c_nationkey, n_nationkey, n_name
    FROM orders
    LEFT JOIN (SELECT l_orderkey,
                      CAST(sum(l_cents * l_quantity) AS DOUBLE) / sum(l_quantity) AS l_cents,
                      count(l_linenumber) AS l_linenumber,
                      count(l_partkey)::DOUBLE + sum(l_quantity) * 2.0::DOUBLE AS l_partkey
               FROM ({LINES_SQL}) GROUP BY l_orderkey) a ON o_orderkey = a.l_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
"""


def plan_reports(spark: SparkSession, d: str) -> DataFrame:
    """The quality report of every step of the plan."""
    reports = tw.run_plan(_flagship_tables(spark, d), _flagship_plan()).reports()
    return reports.select(
        "step_id", "left_rows", "right_rows", "output_rows", "matched_left_rows",
        "matched_right_rows", "left_duplicate_key_rows", "right_duplicate_key_rows",
    )


PLAN_REPORTS_SQL = """
    WITH o AS (SELECT o_orderkey, o_custkey, c_custkey, c_nationkey
               FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
         dup_cust AS (SELECT coalesce(sum(c), 0)::BIGINT AS n FROM
             (SELECT count(*) AS c FROM orders GROUP BY o_custkey) WHERE c > 1),
         dup_nat AS (SELECT coalesce(sum(c), 0)::BIGINT AS n FROM
             (SELECT count(*) AS c FROM o GROUP BY c_nationkey) WHERE c > 1)
    SELECT 'lines' AS step_id, (SELECT count(*) FROM orders) AS left_rows,
           (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS right_rows,
           (SELECT count(*) FROM orders) AS output_rows,
           (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
               AS matched_left_rows,
           (SELECT count(DISTINCT l_orderkey) FROM lineitem
            WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS matched_right_rows,
           0::BIGINT AS left_duplicate_key_rows, 0::BIGINT AS right_duplicate_key_rows
    UNION ALL
    SELECT 'customer', (SELECT count(*) FROM orders), (SELECT count(*) FROM customer),
           (SELECT count(*) FROM orders),
           (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
           (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
           (SELECT n FROM dup_cust), 0
    UNION ALL
    SELECT 'nation', (SELECT count(*) FROM o), (SELECT count(*) FROM nation),
           (SELECT count(*) FROM o),
           (SELECT count(*) FROM o WHERE c_nationkey IN (SELECT n_nationkey FROM nation)),
           (SELECT count(*) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM o)),
           (SELECT n FROM dup_nat), 0
"""

RECIPE = {
    "version": "1.0",
    "tables": [
        {"table_id": "visits", "selected_columns": ["visit_id", "ts", "user_id", "status"]},
        {"table_id": "buys", "selected_columns": ["buy_id", "buy_ts", "buyer"]},
        {"table_id": "customers", "selected_columns": ["c_custkey", "c_name"],
         "dtype_overrides": {"c_name": "string"}},
        {"table_id": "suppliers"},
    ],
    "join_plan": {
        "base_table_id": "visits",
        "steps": [
            {"step_id": "last_buy", "right_table_id": "buys", "join_algorithm": "asof",
             "left_keys": ["ts"], "right_keys": ["buy_ts"], "left_by_keys": ["user_id"],
             "right_by_keys": ["buyer"], "asof_tolerance": "2d"},
            {"step_id": "who", "right_table_id": "customers", "join_type": "inner",
             "left_keys": ["user_id"], "right_keys": ["c_custkey"]},
            {"step_id": "more", "right_table_id": "suppliers", "operation": "union",
             "union_column_mapping": {"s_suppkey": "user_id", "s_name": "c_name",
                                      "s_acctbal": "__DROP__", "s_nationkey": ""},
             "union_add_source_column": True},
        ],
    },
}


def recipe_run(spark: SparkSession, d: str) -> DataFrame:
    """A recipe document with all three kinds of step."""
    visits, buys = _asof_tables(spark, d)
    locations = {
        "visits": visits, "buys": buys,
        "customers": table(spark, d, "customer"), "suppliers": table(spark, d, "supplier"),
    }
    return tw.run_recipe(spark, json.dumps(RECIPE), locations).output


RECIPE_SQL = f"""
    SELECT visit_id, ts, user_id, status, buy_id, buy_ts, buyer,
           c_custkey, c_name, 'current_result' AS _source_table, NULL::INTEGER AS s_nationkey
    FROM ({_asof_sql(">=", where="l.ts - r.buy_ts <= INTERVAL 2 DAY")})
    JOIN customer ON user_id = c_custkey
    UNION ALL
    SELECT NULL, NULL, s_suppkey, NULL, NULL, NULL, NULL, NULL, s_name, 'suppliers', s_nationkey
    FROM supplier
"""


# ------------------------------------------------------------------------ contract


KEPT_RECIPE = {
    "version": "1.0",
    "tables": [
        {"table_id": "customers", "source_file_name": "customers", "dtype_overrides": {"c_name": "string"}},
        {"table_id": "nations", "source_file_name": "nations"},
    ],
    "join_plan": {
        "base_table_id": "customers",
        "steps": [{"step_id": "where", "right_table_id": "nations", "join_type": "left",
                   "left_keys": ["c_nationkey"], "right_keys": ["n_nationkey"]}],
    },
}


def recipe_kept(spark: SparkSession, d: str) -> DataFrame:
    """A recipe over CSV files run twice: the second run reads the step kept by the first."""
    folder = shared_folder(spark)
    places = {"customers": f"{folder}/customers", "nations": f"{folder}/nations"}
    write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), places["customers"])
    write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), places["nations"])
    text = json.dumps(KEPT_RECIPE)
    tw.run_recipe(spark, text, places, cache=f"{folder}/kept")
    return tw.run_recipe(spark, text, places, cache=f"{folder}/kept").output


def csv_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents, whose texts hold line breaks, as CSV below two title lines, read back."""
    folder = f"{shared_folder(spark)}/documents"
    docs = table(spark, d, "documents")
    quoting = {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines = docs.select(F.to_csv(F.struct(*docs.columns), quoting).alias("value"))
    header = ",".join(docs.columns)

    def titled(batches):
        yield pa.RecordBatch.from_pydict({"value": ["documents, all of them", '"as ""CSV"""', header]})
        yield from batches

    lines.mapInArrow(titled, "value string").write.text(folder)
    return read_csv(spark, folder, CsvOptions("utf-8", ",", '"', 3), null_tokens=False)


def entry(spark: SparkSession) -> DataFrame:
    """Orders with aggregated lines, customer and nation."""
    return plan_three_steps(spark, FLAGSHIP_DIR)


def own_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "equi_inner": _documents_labels("inner"),
        "equi_left": _documents_labels("left"),
        "equi_right": _documents_labels("right"),
        "equi_outer": equi_outer,
        "equi_composite": equi_composite,
        "unmatched_left": unmatched_left,
        "unmatched_right": unmatched_right,
        "asof_backward": _asof(),
        "asof_forward": _asof(direction="forward"),
        "asof_nearest": _asof(direction="nearest"),
        "asof_tolerance": _asof(tolerance="6h 30min"),
        "asof_no_exact": _asof(allow_exact=False),
        "asof_no_by": _asof(by=False),
        "asof_no_by_nearest": _asof(by=False, direction="nearest"),
        "asof_split": _asof_hot(),
        "asof_split_forward": _asof_hot(direction="forward", tolerance="1d"),
        "asof_text_keys": asof_text_keys,
        "asof_unmatched_left": asof_unmatched_left,
        "asof_unmatched_right": asof_unmatched_right,
        "union_mapped": union_mapped,
        "union_drop_new": union_drop_new,
        "union_source": union_source,
        "report_equi": _report_equi("left"),
        "report_equi_outer": _report_equi("outer"),
        "report_many_to_many": report_many_to_many,
        "report_asof": report_asof,
        "report_union": report_union,
        "prepare_orders": prepare_orders,
        "profile_orders": profile_orders,
        "infer_types": infer_types,
        "page_orders": page_orders,
        "page_from_directory": page_from_directory,
        "csv_documents": csv_documents,
        "page_after": page_after,
        "page_count": page_count,
        "ts_recorded": ts_recorded,
        "ts_recorded_split": ts_recorded_split,
        "ts_snapshot": ts_snapshot,
        "ts_summary": ts_summary,
        "ts_summary_first": ts_summary_first,
        "ts_wide": ts_wide,
        "ts_interpolated": ts_interpolated,
        "event_frames": event_frames,
        "series_query": series_query,
        "plan_three_steps": plan_three_steps,
        "plan_reports": plan_reports,
        "recipe_run": recipe_run,
        "recipe_kept": recipe_kept,
    }
    for policy in ("keep_both", "left_prefer", "right_prefer"):
        found[f"conflict_{policy}"] = _conflict(policy)
    for method in PREAGG_SQL:
        found[f"preagg_{method}"] = _preagg(method)

    def configured(query: Query) -> Query:
        return lambda spark, d: query(tw.configure(spark), d)

    return {name: configured(query) for name, query in found.items()}


def own_oracle_sql() -> dict[str, str]:
    within = "l.ts - r.buy_ts <= INTERVAL '6 hours 30 minutes'"
    matched_12h = f"""
        SELECT l.visit_id, l.ts, l.user_id, l.status,
               CASE WHEN l.ts - r.buy_ts <= INTERVAL 12 HOUR THEN r.buy_id END AS buy_id
        FROM ({ASOF_LEFT_SQL}) l ASOF LEFT JOIN ({_one_at_a_time(False)}) r ON l.user_id = r.buyer AND l.ts {{}} r.buy_ts
    """
    return {
        "equi_inner": _documents_labels_sql("INNER", "d.doc_id"),
        "equi_left": _documents_labels_sql("LEFT", "d.doc_id"),
        "equi_right": _documents_labels_sql("RIGHT", "l.doc_id"),
        "equi_outer": """
            SELECT l.doc_id, l.quality, l.toxic, e.vec_id, e.label
            FROM labels l FULL JOIN embeddings e ON l.doc_id = e.vec_id""",
        "equi_composite": """
            SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity AS l_quantity_l,
                   r.l_suppkey, r.l_quantity AS l_quantity_r
            FROM lineitem l JOIN lineitem r
              ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber""",
        "unmatched_left": """
            SELECT doc_id, lang, source, n_chars FROM documents d
            WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IS NOT DISTINCT FROM d.doc_id)""",
        "unmatched_right": """
            SELECT * FROM orders o
            WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""",
        "conflict_keep_both": PEOPLE_SQL + """
            SELECT coalesce(l.key, r.key) AS key, l.name AS name_l, l.balance AS balance_l,
                   r.name AS name_r, r.balance AS balance_r, r.nation
            FROM l FULL JOIN r ON l.key = r.key""",
        "conflict_left_prefer": PEOPLE_SQL + """
            SELECT coalesce(l.key, r.key) AS key, coalesce(l.name, r.name) AS name,
                   coalesce(l.balance, r.balance) AS balance, r.nation
            FROM l FULL JOIN r ON l.key = r.key""",
        "conflict_right_prefer": PEOPLE_SQL + """
            SELECT coalesce(l.key, r.key) AS key, coalesce(r.name, l.name) AS name,
                   coalesce(r.balance, l.balance) AS balance, r.nation
            FROM l FULL JOIN r ON l.key = r.key""",
        **{f"preagg_{m}": _preagg_sql(m) for m in PREAGG_SQL},
        "asof_backward": _asof_sql(">="),
        "asof_forward": _asof_sql("<="),
        "asof_nearest": _nearest_sql(by=True),
        "asof_tolerance": _asof_sql(">=", where=within),
        "asof_no_exact": _asof_sql(">"),
        "asof_no_by": _asof_sql(">=", by=False),
        "asof_no_by_nearest": _nearest_sql(by=False),
        "asof_split": _hot_sql(_asof_sql(">=")),
        "asof_split_forward": _hot_sql(_asof_sql("<=", where="r.buy_ts - l.ts <= INTERVAL 1 DAY")),
        "asof_text_keys": f"SELECT visit_id, buy_id, amount FROM ({_asof_sql('>=')})",
        "asof_unmatched_left": f"""
            SELECT visit_id, ts, user_id, status FROM ({matched_12h.format('>=')})
            WHERE buy_id IS NULL""",
        "asof_unmatched_right": f"""
            SELECT * FROM ({ASOF_RIGHT_SQL}) WHERE buy_id NOT IN (
                SELECT buy_id FROM ({matched_12h.format('>')}) WHERE buy_id IS NOT NULL)""",
        "union_mapped": """
            SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS nation,
                   c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
            UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, s_acctbal FROM supplier""",
        "union_drop_new": """
            SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS nation,
                   c_mktsegment AS segment, NULL::VARCHAR AS name_u FROM customer
            UNION ALL SELECT NULL, NULL, s_nationkey, s_suppkey::VARCHAR, s_name FROM supplier""",
        "union_source": """
            SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS nation,
                   c_mktsegment AS segment, 'current_result' AS origin, NULL::DOUBLE AS balance
            FROM customer
            UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, 'supplier', s_acctbal
            FROM supplier""",
        "report_equi": _report_sql(
            _equi_figures("orders", "lineitem", "o_orderkey", "l_orderkey"),
            "left", "pairs + lr - ml", "equi", 3.5),
        "report_equi_outer": _report_sql(
            _equi_figures("orders", "lineitem", "o_orderkey", "l_orderkey"),
            "outer", "pairs + lr - ml + rr - mr", "equi", 3.5),
        "report_many_to_many": _report_sql(
            _equi_figures("customer", "supplier", "c_nationkey", "s_nationkey"),
            "inner", "pairs", "equi", 3.0),
        "report_asof": _report_sql(f"""
            SELECT count(*) AS lr, (SELECT count(*) FROM ({ASOF_RIGHT_SQL})) AS rr,
                   count(buy_id) AS ml, count(DISTINCT buy_id) AS mr,
                   0::BIGINT AS ld, 0::BIGINT AS rd
            FROM ({matched_12h.format('>=')})""", "left", "lr", "asof", 10.0),
        "report_union": _report_sql("""
            SELECT a AS lr, b AS rr, a AS ml, b AS mr, 0::BIGINT AS ld, 0::BIGINT AS rd
            FROM (SELECT (SELECT count(*) FROM customer) AS a, (SELECT count(*) FROM supplier) AS b)
            """, "union", "lr + rr", "union", 10.0, "union_always_matches",
            ", 3::BIGINT AS mapped, 1::BIGINT AS kept_new"),
        "prepare_orders": """
            SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::DOUBLE AS custkey,
                   CASE WHEN o_orderstatus <> 'F' THEN o_totalprice::DECIMAL(18,2)::DOUBLE END
                       AS price,
                   strftime(o_orderdate, '%Y-%m-%d') AS day
            FROM orders""",
        "profile_orders": " UNION ALL ".join(f"""
            SELECT '{c}' AS "column", '{t}' AS inferred_type,
                   count(*) - count({c}) AS null_count,
                   (count(*) - count({c}))::DOUBLE / count(*) AS null_ratio,
                   count(DISTINCT {c}) AS nunique_preview FROM orders"""
            for c, t in [("o_orderkey", "number"), ("o_custkey", "number"),
                         ("o_orderstatus", "string"), ("o_totalprice", "number"),
                         ("o_orderdate", "datetime"), ("o_orderpriority", "string")]),
        "infer_types": """
            SELECT 'event_id' AS "column", 'number' AS inferred_type
            UNION ALL SELECT 'ts', 'datetime' UNION ALL SELECT 'user_id', 'number'
            UNION ALL SELECT 'event_type', 'string' UNION ALL SELECT 'value', 'number'
            UNION ALL SELECT 'props', 'string' UNION ALL SELECT 'user_text', 'number'
            UNION ALL SELECT 'day_text', 'datetime'
            UNION ALL SELECT 'value_text',
                CASE WHEN (SELECT avg(CASE WHEN value >= 1 THEN 1.0 ELSE 0.0 END) FROM events) >= 0.9
                     THEN 'number' ELSE 'string' END""",
        "csv_documents": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "page_from_directory": "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200 OFFSET 1200",
        "page_orders": "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200 OFFSET 600",
        "page_after": """
            SELECT * FROM orders WHERE (o_orderpriority, o_orderkey) > ('2-HIGH', 500)
            ORDER BY o_orderpriority, o_orderkey LIMIT 100""",
        "page_count": """
            SELECT count(*) AS rows, CAST(ceil(count(*) / 200.0) AS BIGINT) AS pages FROM orders""",
        "ts_recorded": RECORDED_SQL,
        "ts_recorded_split": RECORDED_SQL,
        "ts_snapshot": f"""
            SELECT tag, timestamp, value, event_id FROM (
                SELECT *, row_number() OVER (PARTITION BY tag
                    ORDER BY timestamp DESC, event_id DESC) AS n FROM ({SERIES_SQL}))
            WHERE n = 1""",
        "ts_summary": _summary_sql("TIMESTAMP '2024-01-05 01:30:00'", 21_600_000_000, ALL_FUNCTIONS),
        "ts_summary_first": _summary_sql("min(timestamp)", 86_400_000_000, ["average", "min", "max"]),
        "ts_wide": f"""
            PIVOT (SELECT tag, window_start, window_end, summary, value FROM
                ({_summary_sql("TIMESTAMP '2024-01-01'", 43_200_000_000, ["count", "max"])}))
            ON tag IN ('click', 'error', 'purchase', 'signup', 'view')
            USING first(value) GROUP BY window_start, window_end, summary""",
        "ts_interpolated": INTERPOLATED_SQL,
        "event_frames": EVENT_FRAMES_SQL,
        "series_query": f"""
            PIVOT (SELECT tag, window_start, window_end, summary, value FROM
                ({_summary_sql("TIMESTAMP '2024-01-02'", 43_200_000_000, ["max", "count"])})
                WHERE tag <> 'signup' AND window_start >= TIMESTAMP '2024-01-02'
                  AND window_start < TIMESTAMP '2024-01-25')
            ON tag IN ('click', 'error', 'purchase', 'view')
            USING first(value) GROUP BY window_start, window_end, summary""",
        "plan_three_steps": PLAN_SQL,
        "plan_reports": PLAN_REPORTS_SQL,
        "recipe_run": RECIPE_SQL,
        "recipe_kept": """
            SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, n_nationkey::BIGINT AS n_nationkey, n_name
            FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    }


def queries() -> dict[str, Query]:
    if llm is None:
        return own_queries()
    return {**own_queries(), **llm.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    if llm is None:
        return own_oracle_sql()
    pipeline = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {**own_oracle_sql(), **llm.ORACLE_SQL, **pipeline}
