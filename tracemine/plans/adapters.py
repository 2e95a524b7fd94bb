"""Views that derive the domain's tables from the given ones; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ADAPTERS = {
    "fx_exec": """
        SELECT event_id AS instr, concat('in', CAST(event_id % 16 AS STRING)) AS inputfile, concat(event_type, ':', CAST(user_id % 20 AS STRING)) AS atp,
               CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS atp_type
        FROM events WHERE event_type <> 'error'""",
    "fx_branch": """
        SELECT event_id AS seq, concat('in', CAST(event_id % 16 AS STRING)) AS inputfile, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS label
        FROM events WHERE event_type = 'error'""",
    "fx_qbyte": """
        SELECT l.l_orderkey AS instr, concat('in', CAST(o.o_custkey % 16 AS STRING)) AS inputfile, l.l_orderkey % 500 AS lval,
               CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) - 1 AS INT) AS byte_off,
               CAST(l.l_quantity AS INT) % 7 AS tcn, CAST(l.l_partkey % 20 AS INT) AS label1, CAST(l.l_suppkey % 20 AS INT) AS label2,
               (l.l_linenumber = 4 AND l.l_returnflag = 'N') AS untainted
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "fx_gbyte": """
        SELECT g AS dua, g * 16 AS instr, g % 40 AS lval, concat('in', CAST(g % 8 AS STRING)) AS inputfile, concat('f', CAST(g % 10 AS STRING)) AS loc, untainted,
               CAST(row_number() OVER (PARTITION BY g ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS byte_off, CAST(l_partkey % 200 AS INT) AS label1, CAST(l_suppkey % 200 AS INT) AS label2
        FROM (SELECT *, CAST((l_orderkey - l_orderkey % 16) / 16 AS BIGINT) AS g, (l_quantity < 4) AS untainted FROM lineitem) l""",
    "fx_bytes": """
        SELECT 't' AS trace_id, instr AS seq, inputfile, lval, byte_off AS offset_, instr * 8 + byte_off AS ptr, tcn, label1, label2, count(*) OVER (PARTITION BY instr) AS len,
               sum(CASE WHEN untainted THEN 0 ELSE 1 END) OVER (PARTITION BY instr) AS num_tainted, untainted FROM fx_qbyte""",
    "fx_death": """
        SELECT inputfile, label, seq AS death_seq FROM (SELECT *, row_number() OVER (PARTITION BY inputfile, label ORDER BY seq) AS r FROM fx_branch) x WHERE r = 7""",
    "fx_lval": """
        SELECT p_partkey AS lval, CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, '.lava_chaff') WHEN p_partkey % 11 = 0 THEN concat('nodua ', p_name) ELSE p_name END AS ast_name,
               concat('f', CAST(p_partkey % 50 AS STRING)) AS file, p_size AS begin_line FROM part""",
    "fx_dua": """
        SELECT o_orderkey AS dua, o_custkey % 200 AS lval, concat('in', CAST(o_custkey % 16 AS STRING)) AS inputfile, o_orderkey AS instr, (o_orderpriority = '5-LOW') AS fake_dua,
               CAST(o_orderkey % 7 AS INT) AS max_tcn, o_orderkey % 1000 AS trace_index, concat('f', CAST(o_custkey % 50 AS STRING)) AS file,
               CAST(o_orderkey % 40 AS INT) AS line, CAST(o_orderkey % 9 AS INT) AS column_ FROM orders""",
    "fx_dua_label": "SELECT DISTINCT l_orderkey AS dua, CAST(l_partkey % 20 AS INT) AS label FROM lineitem",
    "fx_dua_bytes": "SELECT DISTINCT l_orderkey * 8 + l_linenumber AS dua_bytes, l_orderkey AS dua, l_linenumber AS low, l_linenumber + 4 AS high FROM lineitem",
    "fx_bug": """
        SELECT o.o_orderkey AS bug, CAST(o.o_orderkey % 9 AS INT) AS kind, o.o_orderkey * 8 + f.line AS trigger_, o.o_custkey % 200 AS trigger_lval, o.o_custkey % 100 AS atp,
               o.o_orderkey % 50 AS max_liveness, o.o_orderkey * 7919 % 4294967296 AS magic, concat('f', CAST(o.o_custkey % 50 AS STRING)) AS file, CAST(o.o_custkey % 40 AS INT) AS line
        FROM orders o JOIN (SELECT l_orderkey, min(l_linenumber) AS line FROM lineitem GROUP BY l_orderkey) f ON o.o_orderkey = f.l_orderkey""",
    "fx_bug_extra": """
        SELECT * FROM (SELECT l_orderkey AS bug, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 2 AS INT) AS pos, l_orderkey * 8 + l_linenumber AS dua_bytes
                       FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) d) e
        WHERE pos >= 0 AND pos < CASE bug % 9 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 1 WHEN 8 THEN 1 ELSE 0 END""",
    "fx_atp": "SELECT c_custkey AS atp, CAST(c_custkey % 6 AS INT) AS type, concat('src/f', CAST(c_nationkey AS STRING), '.c') AS file, CAST(c_custkey % 40 AS INT) AS line FROM customer",
    "fx_build_bug": "SELECT l_suppkey AS build, l_orderkey AS bug FROM lineitem WHERE l_returnflag = 'R'",
    "fx_run": """
        SELECT event_id AS run, concat('in', CAST(user_id % 16 AS STRING)) AS input, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 1500 END AS fuzzed,
               CASE event_type WHEN 'error' THEN 139 WHEN 'click' THEN -11 WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 ELSE -9 END AS exitcode,
               concat('start', chr(10), 'LAVALOG: ', CAST(event_id % 1500 AS STRING), ': x', chr(10), CASE WHEN event_id % 3 = 0 THEN 'LAVALOG: 0: y' ELSE 'LAVALOG: 7: z' END) AS output FROM events""",
    "fx_entry": """
        SELECT concat('t', CAST(user_id % 8 AS STRING)) AS trace_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN concat('f', regexp_extract(props, '([0-9]+)', 1)) END AS filename,
               CASE event_type WHEN 'signup' THEN 'fileTaintMatch' WHEN 'view' THEN 'sourceTraceId' WHEN 'error' THEN 'taintedBranch' WHEN 'click' THEN 'taintQueryPri' ELSE 'attackPoint' END AS kind,
               CAST(event_id % 40 AS BIGINT) AS loc_id FROM events""",
    "fx_dict": "SELECT CAST(c_custkey AS INT) AS id, concat(CAST(c_custkey AS STRING), ':5:', CAST(c_custkey + 1 AS STRING), ':9:', CASE WHEN c_custkey % 5 = 0 THEN 'a.h' ELSE concat('f', CAST(c_nationkey AS STRING), '.c') END) AS value FROM customer",
    "fx_call": """
        SELECT concat('t', CAST(conv_id % 50 AS STRING)) AS trace_id, conv_id * 100 + turn AS seq, (length(text) % 5 < 3) AS is_call, concat('fn', CAST(length(text) % 9 AS STRING)) AS callee,
               concat('f', CAST(length(text) % 4 AS STRING)) AS callee_file FROM conversations""",
    "fx_elem": """
        SELECT 't' AS trace_id, l_orderkey AS seq, CAST(l_linenumber AS INT) AS pos, l_partkey AS ptr, concat('in', CAST(l_suppkey % 4 AS STRING)) AS inputfile, CAST(l_suppkey % 20 AS INT) AS label1,
               CAST(l_quantity AS INT) AS label2, l_extendedprice AS price FROM lineitem""",
    "fx_fun": "SELECT concat('p', CAST(p_partkey AS STRING)) AS name, (p_partkey % 7 <> 0) AS hasbody FROM part UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)) AS name, (s_suppkey % 9 <> 0) AS hasbody FROM supplier",
    "fx_callgraph": """
        SELECT DISTINCT concat(CASE WHEN r = 2 THEN 's' ELSE 'p' END, CAST(CASE WHEN r = 2 THEN l_suppkey ELSE l_partkey END AS STRING)) AS name,
               CASE r WHEN 1 THEN concat('s', CAST(l_suppkey AS STRING)) WHEN 2 THEN concat('p', CAST(l_partkey AS STRING)) ELSE concat('o', CAST(l_orderkey AS STRING)) END AS containing_function
        FROM (SELECT *, CASE WHEN l_quantity < 3 THEN 1 WHEN l_quantity > 49 AND l_linenumber = 1 THEN 2 ELSE 3 END AS r FROM lineitem) x""",
    "fx_passed": """
        SELECT concat('p', CAST(l_partkey AS STRING)) AS arg, concat('s', CAST(l_suppkey AS STRING)) AS callee,
               CASE WHEN l_linenumber = 1 AND l_discount > 0.08 THEN 'function' ELSE 'var' END AS info FROM lineitem""",
    "fx_assign": "SELECT DISTINCT concat('p', CAST(p_partkey AS STRING)) AS name FROM part WHERE p_size = 7",
    "fx_step": "SELECT event_id AS index, concat('f', CAST(user_id % 50 AS STRING)) AS file, CAST(event_id % 40 AS INT) AS line, CAST(event_id % 9 AS INT) AS column_ FROM events",
    "fx_frame": "SELECT l_orderkey AS bug, CAST(l_linenumber AS INT) AS pos, max(concat('p', CAST(l_partkey AS STRING))) AS function FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "fx_path": "SELECT CAST(user_id AS BIGINT) AS run, event_id AS i, CASE WHEN event_id % 13 = 0 THEN 'LX' ELSE translate(CAST(event_id % 1000 AS STRING), '0123456789', 'LRLRLRLRLR') END AS path FROM events",
    "fx_line": "SELECT doc_id AS report, n_chars AS line_no, concat('TOTAL ', CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE concat(CAST(doc_id % 100 AS STRING), '.', CAST(n_chars % 100 AS STRING), '% 7.0%') END) AS line FROM documents",
}


#: Rows of lineitem that one task takes where adapters number or count the rows of an order.
ROWS_OF_TASK = 250_000


def needed(sql: str) -> list[str]:
    """The adapters that sql uses, each after those it uses itself."""
    out: list[str] = []
    for name in ADAPTERS:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in [*needed(ADAPTERS[name]), name] if x not in out]
    return out


def with_adapters(sql: str) -> str:
    """sql with the adapters that it uses as common table expressions."""
    views = ", ".join(f"{x} AS ({ADAPTERS[x]})" for x in needed(sql))
    rest = sql.strip()
    if not views:
        return rest
    if rest.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {rest[len('WITH RECURSIVE') :]}"
    return f"WITH {views}, {rest[4:]}" if rest.upper().startswith("WITH ") else f"WITH {views} {rest}"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """An adapter by name, or sql over adapters and tables.

    The adapters of bytes look at the rows of an order together, several times in one task; tasks are then as many as lineitem's rows ask for, if that is more than the session's.
    """
    text = with_adapters(f"SELECT * FROM {sql}" if sql in ADAPTERS else sql)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if t == "lineitem" and "fx_qbyte" in needed(text):
                tasks = -(-rows.count() // ROWS_OF_TASK)
                if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
                    rows = rows.repartition(tasks, "l_orderkey")
            rows.createOrReplaceTempView(t)
    return spark.sql(text)
