"""Result tables filled by runs: a run appears in all its tables at once, and only once.

A run writes each table's rows to a folder of its own attempt, by day. Then one file
named after the run is created in ``_runs``; it must not exist yet, and it lists the
attempt's folders. Readers take the folders that committed runs list. So a run that is
repeated, or written by two drivers at a time, is there once, and what a lost attempt
left behind is never read. ``sweep`` removes such leftovers.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog.functions.times import day_number
from wardlog.sources.files import Markers
from wardlog.sources.sinks import write_by_day

_RESULT = """model_id bigint, logtime timestamp_ntz, `end` timestamp_ntz, rule string, src_ip string, dst_ip string,
    src_ip_country_code string, dst_ip_country_code string, ast_ip int, related_ip int, direction_inout string,
    direction_inout_bin int, related_country string, att_name string, result bigint, probs {probs}, anomaly_score double,
    feedback string, packet int, if_label int, if_score int, lof_label int, lof_score int, ai_label int, ai_score int"""
SCHEMAS = {
    "result": _RESULT.format(probs="double"),
    "result_text": _RESULT.format(probs="string"),
    "evidence": """model_id bigint, logtime timestamp_ntz, `end` timestamp_ntz, src_ip string, dst_ip string,
        dst_port_cnt double, info_st double, succ_st double, redir_st double, cler_st double, serer_st double, oth_st double,
        http_host array<string>, http_host_value array<double>, http_agent array<string>, http_agent_value array<double>,
        http_query array<string>, http_query_value array<double>, model_ver string, att_name string""",
    "explanation": """model_id bigint, version string, logtime timestamp_ntz, src_ip string, dst_ip string,
        feature array<string>, score array<double>, rest double, prediction string""",
    "tree_nodes": """model_id bigint, logtime timestamp_ntz, attack_nm string, value string, features string,
        node_num bigint, node_from string, node_to_left string, node_to_right string, level int, model_ver string""",
    "importance": """model_id bigint, logtime timestamp_ntz, attack_nm string, weekday string, dayhour string,
        feature string, value double""",
    "metrics": "model_id bigint, attack_name string, epochs bigint, loss double, accuracy double, logtime timestamp_ntz",
    "history": """model_id bigint, attack_name string, epochs bigint, loss double, logtime timestamp_ntz,
        train_cnt bigint, test_cnt bigint, accuracy double, recall double, precision double, f1_score double""",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(SCHEMAS[table].split()))


class RunTables:
    """The tables below ``root``, a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._markers = Markers(spark, f"{self.root}/_runs")

    def runs(self, prefix: str = "") -> dict[str, dict]:
        """What each committed run wrote: table -> folder, and its notes."""
        return self._markers.read(prefix)

    def commit(self, run: str, tables: Mapping[str, DataFrame], notes: Mapping | None = None) -> bool:
        """Writes the rows of a run; False, with nothing changed, if the run is there already.

        ``run`` may hold letters, digits, dots, dashes and underscores. Rows are taken by
        column name and filed by the day of ``logtime``.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run):
            raise ValueError(f"not a run name: {run!r}")
        if run in self._markers.names():
            return False
        attempt, folders = uuid.uuid4().hex, {}
        for table, rows in tables.items():
            folders[table] = f"{table}/{run}/{attempt}"
            shaped = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema_of(table)])
            write_by_day(shaped.withColumn("logdate", day_number(F.col("logtime"))), f"{self.root}/{folders[table]}")
        if self._markers.claim(run, {"tables": folders, "notes": dict(notes or {})}):
            return True
        for folder in folders.values():  # another writer was first
            self._markers.delete(f"{self.root}/{folder}")
        return False

    def read(self, table: str, prefix: str = "") -> DataFrame:
        """The rows of all committed runs, or of those whose names begin with ``prefix``, with ``logdate``."""
        schema = schema_of(table).add("logdate", T.IntegerType())
        folders = [run["tables"][table] for run in self.runs(prefix).values() if table in run["tables"]]
        folders = [f"{self.root}/{f}" for f in folders if any(n.startswith("logdate=") for n in self._markers.list(f"{self.root}/{f}"))]
        if not folders:
            return self.spark.createDataFrame([], schema)
        # the pattern keeps run and attempt from being read as columns
        paths = [f"{f}/logdate=*" for f in folders]
        rows = self.spark.read.schema(schema_of(table)).parquet(*paths)
        return rows.withColumn("logdate", day_number(F.col("logtime")))

    def sweep(self) -> int:
        """Removes folders of attempts that no committed run lists; not while a run is being written."""
        kept = {folder for run in self.runs().values() for folder in run["tables"].values()}
        gone = 0
        for table in SCHEMAS:
            for run in self._markers.list(f"{self.root}/{table}"):
                for attempt in self._markers.list(f"{self.root}/{table}/{run}"):
                    if f"{table}/{run}/{attempt}" not in kept:
                        self._markers.delete(f"{self.root}/{table}/{run}/{attempt}")
                        gone += 1
        return gone
