"""Requests as JSON lines, and their responses (SC5, SC13, SS9, SS10, PR20).

A request names an action: ping, shutdown, or process with path and type. Rows that
are no JSON objects, or ask for anything else, become error responses; the others go on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from quillon.sources.media import extension

REQUEST = "id string, action string, type string, path string, _bad string"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """SC5: ``lines`` with request_id, action, type, path, and error_code and error_message of requests that fail."""
    rows = lines.filter(F.length(F.trim(column)) > 0)
    r = F.from_json(column, REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("_r", r)
    text = lambda n: F.col(f"_r.{n}")
    is_object = F.coalesce(F.trim(F.col(column)).startswith("{"), F.lit(False))
    broken = text("_bad").isNotNull()
    action, path, kind = text("action"), text("path"), text("type")
    blank = F.length(F.trim(F.coalesce(path, F.lit("")))) == 0
    known = F.when(kind == "image", extension(path).isin(*IMAGE_EXTENSIONS)).when(kind == "video", extension(path).isin(*VIDEO_EXTENSIONS)).otherwise(F.lit(False))
    process = F.coalesce(action == "process", F.lit(False))
    message = (
        F.when(broken, "not a JSON object")
        .when(~is_object, "Request must be a JSON object")
        .when(F.coalesce(action.isin("ping", "shutdown"), F.lit(False)), None)
        .when(~process, F.concat(F.lit("Unsupported action: "), F.coalesce(action, F.lit("None"))))
        .when(blank, "path must be a nonempty string")
        .when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("Unsupported type or extension: "), F.coalesce(kind, F.lit("None")), F.lit(", "), F.coalesce(extension(path), F.lit(""))))
    )
    code = F.when(broken, "JSONDecodeError").when(message.isNotNull(), "ValueError")
    return rows.select(*lines.columns, F.coalesce(text("id"), F.lit("")).alias("request_id"), action.alias("action"), kind.alias("input_type"), path.alias("path"), code.alias("error_code"), message.alias("error_message"))


def response(error_code: Column, error_message: Column) -> Column:
    """The response of a request that needs no processing, as JSON."""
    error = F.struct(F.col("request_id"), F.lit("error").alias("status"), F.struct(error_code.alias("code"), error_message.alias("message")).alias("error"))
    done = F.struct(F.col("request_id"), F.lit("success").alias("status"), F.col("action"))
    return F.when(error_code.isNotNull(), F.to_json(error)).when(F.col("action").isin("ping", "shutdown"), F.to_json(done))


def answered(lines: DataFrame, column: str = "value") -> DataFrame:
    """Requests with `response`, null for those that are to be processed."""
    return parsed(lines, column).withColumn("response", response(F.col("error_code"), F.col("error_message")))


def answer_lines(spark: SparkSession, lines: Iterable[str], process: Callable[[dict], dict], emit: Callable[[str], None]) -> bool:
    """SS9: answers lines one by one, as they come, until a shutdown request (True) or their end.

    ``process`` takes a request and returns its response; its errors become error responses.
    """
    emit('{"event":"starting"}')
    emit('{"event":"ready"}')
    for line in lines:
        for row in answered(spark.createDataFrame([(line,)], "value string")).collect():
            stop = _answer(row, process, emit)
            if stop:
                return True
    return False


def _answer(row, process: Callable[[dict], dict], emit: Callable[[str], None]) -> bool:
    """Emits the response of one parsed request; whether it asks for shutdown."""
    if row["response"] is not None:
        emit(row["response"])
        return row["error_code"] is None and row["action"] == "shutdown"
    try:
        out = process({k: row[k] for k in ("request_id", "input_type", "path")})
    except Exception as e:
        out = {"status": "error", "error": {"code": type(e).__name__, "message": str(e)}}
    emit(json.dumps({"request_id": row["request_id"]} | out, ensure_ascii=False, separators=(",", ":")))
    return False


def serve(lines: DataFrame, process: Callable[[dict], dict], emit: Callable[[str], None], checkpoint: str, order: str = "ordinal", trigger: dict | None = None):
    """SS9: answers a stream of lines in the order of ``order``, batch by batch, until a shutdown request; returns the query.

    ``process`` takes a request (request_id, input_type, path) and returns the
    response; its errors become error responses. A batch's requests come to the
    driver, as to any server: they are the queries, not the data.
    """
    state = {"stop": False}
    emit('{"event":"starting"}')
    emit('{"event":"ready"}')

    def batch(df: DataFrame, _: int) -> None:
        for row in answered(df).orderBy(order).toLocalIterator():
            if state["stop"]:
                return
            state["stop"] = _answer(row, process, emit)

    query = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    query.stopped_by_request = lambda: state["stop"]
    return query
