"""Candidate questions from the text that a model wrote: whole answers as they are, cut or broken ones as far as objects are complete."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import table

FENCE = re.compile(r"^```(?:json)?|```$", re.IGNORECASE)
LIST = re.compile(r'"questions"\s*:\s*\[')
DECODER = json.JSONDecoder()


def objects_of(text: str | None) -> tuple[list[str], bool, str]:
    """The questions as JSON texts, whether they were salvaged, and `ok` or why there are none."""
    text = FENCE.sub("", (text or "").strip()).strip()
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    try:
        data = json.loads(text)
    except ValueError:
        data = None
    found = data.get("questions") if isinstance(data, dict) else data
    if isinstance(found, list):
        return [dump(x) for x in found], False, "ok"
    begin = LIST.search(text)
    if begin is None:
        return [], True, "no_list"
    out, at = [], begin.end()
    while (at := text.find("{", at)) >= 0:
        try:
            found, at = DECODER.raw_decode(text, at)
        except ValueError:
            break
        out.append(dump(found))
    return out, True, "ok" if out else "nothing_whole"


def parse(outputs: DataFrame, text: str = "output") -> DataFrame:
    """`outputs` with questions (array of JSON texts), salvaged, status, and how many questions the text began (by their quotes' keys). A null text has no list."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([objects_of(t) for t in texts], columns=["questions", "salvaged", "status"])

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    parsed: Column = F.pandas_udf(run, "questions array<string>, salvaged boolean, status string")(text)
    begun = F.size(F.split(F.coalesce(F.col(text), F.lit("")), '"evidence_quote"')) - 1
    return outputs.withColumn("_p", parsed).select(*outputs.columns, "_p.questions", "_p.salvaged", "_p.status", begun.alias("begun"))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """An order's line items as a model would write questions; some answers are fenced, some cut, some without a list."""
    text = F.format_string('{"question": "Q%d {of} \\"%s\\"", "evidence_quote": "part [%d] }"}', "l_linenumber", "l_returnflag", "l_partkey")
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("t")))).alias("x"))
    whole = F.concat(F.lit('{"questions": ['), F.array_join(F.transform("x", lambda v: v["t"]), ", "), F.lit("]}"))
    k = F.col("run_id")
    share = F.floor(F.length(whole) * (k % 10) / 10).cast("int")
    return items.select("run_id", F.when(k % 3 == 0, whole).when(k % 3 == 1, F.substring(whole, F.lit(1), share)).when(k % 2 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(F.replace(whole, F.lit('"questions"'), F.lit('"items"'))).alias("output"))


QUERIES = {
    "parsed_candidates": lambda s, d: parse(_outputs(s, d)).select("run_id", F.size("questions").alias("n"), F.sha2(F.array_join("questions", "\n"), 256).alias("hash"), "salvaged", "status", "begun"),
}
ORACLES = {
    "parsed_candidates": r"""WITH t AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS k, '{"question": "Q' || l_linenumber || ' {of} \"' || l_returnflag || '\"", "evidence_quote": "part [' || l_partkey || '] }"}' AS t FROM lineitem),
      e AS (SELECT *, 15 + sum(length(t) + 2) OVER (PARTITION BY run_id ORDER BY k ROWS UNBOUNDED PRECEDING) - 2 AS ends, 15 + sum(length(t) + 2) OVER (PARTITION BY run_id) AS size, 16 + length('"question": "Q') FROM t),
      g AS (SELECT *, CASE WHEN run_id % 3 = 1 THEN floor(size * (run_id % 10) / 10) ELSE size END AS cut, ends - length(t) + strpos(t, '"evidence_quote"') + 15 AS quote_end FROM e),
      w AS (SELECT run_id, any_value(cut) AS cut, any_value(size) AS size, count(*) FILTER (ends <= cut) AS n, string_agg(t, chr(10) ORDER BY k) FILTER (ends <= cut) AS text, count(*) FILTER (quote_end <= cut) AS begun FROM g GROUP BY 1)
      SELECT run_id, CAST(CASE WHEN run_id % 3 = 2 AND run_id % 2 = 1 THEN 0 ELSE n END AS INT) AS n, sha256(CASE WHEN run_id % 3 = 2 AND run_id % 2 = 1 THEN '' ELSE coalesce(text, '') END) AS hash, run_id % 3 = 1 OR (run_id % 3 = 2 AND run_id % 2 = 1) AS salvaged,
        CASE WHEN (run_id % 3 = 2 AND run_id % 2 = 1) OR (run_id % 3 = 1 AND cut < 15) THEN 'no_list' WHEN n = 0 THEN 'nothing_whole' ELSE 'ok' END AS status, CAST(begun AS INT) AS begun FROM w""",
}
