"""The derived contract corpus: one contract for each order, one clause for each line.

Written once as SQL text for both engines; ``{text}`` is the name of the string type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-09-02"

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"

#: Views in the order of their dependence.
VIEWS: dict[str, str] = {
    "lines": f"""
        SELECT l_orderkey AS document_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS INT) AS ord,
               CAST(floor(l_quantity) AS BIGINT) AS q, l_linenumber, l_suppkey, l_partkey, l_returnflag, CAST(l_shipdate AS DATE) AS ship_date
        FROM lineitem""",
    "corpus_a": """
        SELECT document_id, ord, concat(CAST(document_id AS {text}), '-', CAST(ord AS {text})) AS clause_id, concat(CAST(ord AS {text}), '.1') AS number,
               CASE l_returnflag WHEN 'A' THEN 'PAYMENT' WHEN 'R' THEN 'TERMINATION' ELSE 'RENEWAL' END AS heading,
               CASE l_returnflag
                 WHEN 'A' THEN concat('The Customer shall pay each invoice within ', CAST(q AS {text}), ' days of the invoice date.')
                 WHEN 'R' THEN concat('Supplier ', CAST(l_suppkey AS {text}), ' may terminate on ', CAST(q AS {text}), ' days written notice under clause ', CAST(l_linenumber + 1 AS {text}), '.1.')
                 ELSE concat('This Agreement shall automatically renew unless notice is given ', CAST(q AS {text}), ' days before expiry.') END AS text,
               q AS n_days, l_linenumber, l_suppkey, l_partkey, l_returnflag, ship_date
        FROM lines""",
    "corpus_b": """
        SELECT document_id, ord, clause_id, number, heading,
               CASE WHEN l_suppkey % 7 = 0 THEN replace(text, concat(' ', CAST(n_days AS {text}), ' days'), concat(' ', CAST(n_days + 5 AS {text}), ' days')) ELSE text END AS text,
               CASE WHEN l_suppkey % 7 = 0 THEN n_days + 5 ELSE n_days END AS n_days, l_linenumber, l_suppkey, l_partkey, l_returnflag, ship_date
        FROM corpus_a WHERE l_linenumber <> 3""",
    "corpus_parties": """
        SELECT DISTINCT document_id, party_id, name, role FROM (
          SELECT o_orderkey AS document_id, concat('c', CAST(c_custkey AS {text})) AS party_id, c_name AS name, 'customer' AS role FROM orders JOIN customer ON c_custkey = o_custkey
          UNION ALL
          SELECT l_orderkey, concat('s', CAST(s_suppkey AS {text})), s_name, 'supplier' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) p""",
    "corpus_obligations": """
        SELECT document_id, concat('o', clause_id) AS obligation_id, ord, clause_id, concat('c', CAST(o_custkey AS {text})) AS obligor_id, concat('s', CAST(l_suppkey AS {text})) AS obligee_id,
               CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('d', clause_id) END AS deadline_id, l_linenumber % 5 = 0 AS informational, text AS summary, l_partkey % 2 = 0 AS has_consequence,
               CASE WHEN l_linenumber = 6 OR (l_linenumber = 4 AND l_partkey % 2 = 1) THEN concat('k', clause_id) END AS trigger_id
        FROM corpus_a JOIN orders ON o_orderkey = document_id WHERE l_returnflag = 'A'""",
    "corpus_conditions": """
        SELECT document_id, concat('k', clause_id) AS condition_id, clause_id, CASE l_returnflag WHEN 'A' THEN 'breach' WHEN 'R' THEN 'termination' ELSE 'renewal' END AS condition_type
        FROM corpus_a WHERE l_linenumber = 6 OR (l_linenumber = 4 AND l_partkey % 2 = 1)""",
    "corpus_rights": """
        SELECT document_id, concat('r', clause_id) AS right_id, ord, clause_id, concat('s', CAST(l_suppkey AS {text})) AS holder_id, concat('c', CAST(o_custkey AS {text})) AS counterparty_id, text AS summary
        FROM corpus_a JOIN orders ON o_orderkey = document_id WHERE l_returnflag = 'R'""",
    "corpus_deadlines": """
        SELECT document_id, concat('d', clause_id) AS deadline_id, ord, clause_id,
               CASE WHEN l_linenumber % 4 = 0 THEN 'unspecified' WHEN l_returnflag = 'N' THEN 'relative' ELSE 'fixed' END AS date_type,
               CASE WHEN l_linenumber % 4 <> 0 AND l_returnflag <> 'N' THEN ship_date END AS date,
               CASE WHEN l_linenumber % 4 <> 0 AND l_returnflag = 'N' THEN CAST(n_days AS INT) END AS offset_amount,
               CAST(o_orderdate AS DATE) AS anchor_date, text AS description
        FROM corpus_a JOIN orders ON o_orderkey = document_id""",
}


def needed(*views: str) -> list[str]:
    """The views and what they need, in the order of their dependence."""
    need, todo = set(), list(views)
    while todo:
        name = todo.pop()
        need.add(name)
        todo += [v for v in VIEWS if v not in need and f" {v}" in VIEWS[name].replace("\n", " ")]
    return [v for v in VIEWS if v in need]


def dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` with their orders as ``placed``, dealt out once by contract, for queries over many tables of the model.

    All tables are made of these rows where they lie. The columns travel in a list of one entry, which
    hides them from Spark, and no filter passes the partition's number: every table then reads the same
    exchange, and none has one of its own. Nor does Spark see in the key the column by which the rows
    are numbered, or it would merge the two exchanges and, as it finds few bytes, use few tasks.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey is not null")
    placed = orders.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.collect_list(F.struct("o_custkey", "o_orderdate")).alias("placed"))
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(placed, "l_orderkey", "left")
    sql = VIEWS["lines"].format(text="STRING").replace("ship_date\n", "ship_date, placed\n").replace("FROM lineitem", "FROM {lineitem}")
    rows = spark.sql(sql, lineitem=lineitem)
    key = F.when(F.col("document_id").isNotNull(), F.col("document_id")).alias("document_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key, F.array(F.struct(*[c for c in rows.columns if c != "document_id"])).alias("every")).repartition(n, "document_id")
    return dealt.select("document_id", F.when(F.spark_partition_id() >= 0, F.col("every")).alias("every")).select("document_id", F.inline("every"))


def dealt_parties(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """``corpus_parties`` by contract, the suppliers taken from dealt ``lines``."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    party = lambda rows, letter, key, name, role: rows.select("document_id", F.concat(F.lit(letter), F.col(key).cast("string")).alias("party_id"), F.col(name).alias("name"), F.lit(role).alias("role")).repartition(n, "document_id")
    buyers = read("orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("c_custkey")).join(read("customer").select("c_custkey", "c_name"), "c_custkey")
    sellers = lines.select("document_id", F.col("l_suppkey").alias("s_suppkey")).distinct().join(read("supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return party(buyers, "c", "c_custkey", "c_name", "customer").unionByName(party(sellers, "s", "s_suppkey", "s_name", "supplier")).distinct()


def _over_dealt(sql: str, made: dict[str, DataFrame]) -> DataFrame:
    """A view over dealt rows, whose orders lie in ``placed``, without a join.

    By column expressions and not as a query: Spark 4.1 does not see that the sides of a union lie
    alike if their columns bear the name of a table.
    """
    columns, source, joined, condition = re.fullmatch(r"\s*SELECT\s+(.+)\s+FROM\s+(\w+)(\s+JOIN orders ON o_orderkey = document_id)?(?:\s+WHERE\s+(.+))?", sql, re.DOTALL).groups()
    rows = made[source].where(condition) if condition else made[source]
    rows = rows.select("*", F.inline("placed")) if joined else rows
    # The columns end at the commas outside of all brackets.
    depth = [columns[:i].count("(") - columns[:i].count(")") for i in range(len(columns))]
    ends = [-1, *(i for i, c in enumerate(columns) if c == "," and depth[i] == 0), len(columns)]
    return rows.selectExpr(*(columns[i + 1 : j] for i, j in zip(ends, ends[1:], strict=False)), "placed")


def corpus(spark: SparkSession, sf_dir: str, *views: str, lines: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Views of the corpus as DataFrames over the Parquet tables of ``sf_dir``; no name of the session is taken.

    With :func:`dealt_lines` as ``lines`` they are made of these, and each contract's rows lie together.
    """
    made = {table: spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("lineitem", "orders", "customer", "supplier")}
    if lines is not None:
        made |= {"lines": lines, "corpus_parties": dealt_parties(spark, sf_dir, lines)}
    for name in needed(*views):
        if name in made:
            continue
        if lines is not None:
            made[name] = _over_dealt(VIEWS[name].format(text="STRING"), made)
            continue
        sql = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in made else m[0], VIEWS[name].format(text="STRING"))
        made[name] = spark.sql(sql, **{k: v for k, v in made.items() if f"{{{k}}}" in sql})
    return tuple(made[v] for v in views)


def ctes(*views: str) -> str:
    """``WITH`` text for DuckDB that defines the views and what they need."""
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name].format(text='VARCHAR')})" for name in needed(*views)) + " "
