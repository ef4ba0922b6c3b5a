"""Ingestion: tolerant parsing of stored model and OCR responses, stream chunks, page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bracketed(x: Column) -> Column:
    """``x`` if it begins and ends like a JSON object or array; a parser would ignore what follows a value."""
    return F.when(x.rlike(r"(?s)^(?:\{.*\}|\[.*\])$"), x)


def json_text(raw: Column, repair: bool = True) -> Column:
    """The JSON text of a response, or null.

    Tried in order: the fenced block or else the whole text; its first ``{`` to its
    last ``}``; with ``repair``, the text from its first ``{`` with ``"}`` added,
    where its last string isn't ended (an odd number of plain quotes).
    """
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(raw))
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    open_end = F.regexp_extract(body, r"(?s)\{.*$", 0)
    quotes = F.length(F.regexp_replace(F.regexp_replace(open_end, r"(?s)\\.", ""), '[^"]', ""))
    cut = F.when((quotes % 2 == 1) & (open_end != ""), F.concat(open_end, F.lit('"}')))
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    found = F.coalesce(valid(_bracketed(body)), valid(F.nullif(inner, F.lit(""))))
    return F.coalesce(found, valid(cut)) if repair else found


def parse_responses(responses: DataFrame) -> DataFrame:
    """``responses(id, raw)`` to (id, json, ok)."""
    parsed = json_text(F.col("raw"))
    return responses.select("id", F.coalesce(parsed, F.lit("")).alias("json"), parsed.isNotNull().alias("ok"))


def response_records(responses: DataFrame) -> DataFrame:
    """One row per JSON object of a response: ``{"records": [...]}``, an array, or one object.

    Members that aren't objects are skipped; a response without any gives an error row (position null).
    """
    text = json_text(F.col("raw"))
    listed = F.when(F.get_json_object(text, "$.records[0]").isNotNull(), F.get_json_object(text, "$.records")).otherwise(F.when(text.startswith("["), text))
    members = F.coalesce(F.from_json(listed, "array<string>"), F.array(text))
    objects = F.filter(members, lambda m: m.startswith("{"))
    rows = responses.select("id", F.posexplode_outer(objects).alias("position", "record"))
    return rows.select("id", F.col("position").cast("long").alias("position"), F.coalesce("record", F.lit("")).alias("record"))


def collect_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks(id, seq, text)`` joined in order; comments (``:``) and all from ``[DONE]`` on are left out."""
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_chunks = chunks.withColumn("done", F.max((F.col("text") == "[DONE]").cast("int")).over(w)).where((F.col("done") == 0) & ~F.col("text").startswith(":"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return open_chunks.groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"), F.count("*").alias("n_chunks"))


def merge_page_text(pages: DataFrame) -> DataFrame:
    """``pages(id, page, text)``: one page as it is; several under ``[page i]`` headers, blank ones dropped but counted."""
    n = pages.groupBy("id").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    shown = F.filter(F.transform("p", lambda x, i: F.struct((i + 1).alias("i"), x["text"].alias("t"))), lambda x: F.trim(x["t"]) != "")
    several = F.array_join(F.transform(shown, lambda x: F.concat(F.lit("[page "), x["i"].cast("string"), F.lit("]\n"), x["t"])), "\n")
    return n.select("id", "n_pages", F.when(F.col("n_pages") == 1, F.col("p")[0]["text"]).otherwise(several).alias("text"))


PAYLOAD = "errorCode int, rec_texts array<string>, rec_boxes array<array<double>>, rec_polys array<array<array<double>>>, rec_scores array<double>"


def ingest_tokens(payloads: DataFrame) -> DataFrame:
    """``payloads(id, payload)`` to tokens: text, score and box; polygons become their envelope.

    Payloads with an error code give no token (see ``payload_errors``). Blank texts
    and texts without a box are dropped; the token index counts all texts.
    """
    p = payloads.select("id", F.from_json("payload", PAYLOAD).alias("p")).where(F.coalesce("p.errorCode", F.lit(0)) == 0)
    xs = lambda poly, i: F.transform(poly, lambda point: point[i])
    envelope = F.transform("p.rec_polys", lambda poly: F.array(F.array_min(xs(poly, 0)), F.array_min(xs(poly, 1)), F.array_max(xs(poly, 0)), F.array_max(xs(poly, 1))))
    rows = p.select("id", F.posexplode(F.arrays_zip(F.col("p.rec_texts").alias("text"), F.coalesce("p.rec_boxes", envelope).alias("box"), F.col("p.rec_scores").alias("score"))).alias("token_index", "t"))
    rows = rows.where((F.trim("t.text") != "") & (F.size("t.box") == 4))
    return rows.select("id", F.col("token_index").cast("long").alias("token_index"), F.trim("t.text").alias("text"), F.col("t.score").alias("score"), *[F.col("t.box")[i].alias(n) for i, n in enumerate(("left", "top", "right", "bottom"))])


LAYOUT = "rec_texts array<string>, blocks array<struct<block_content: string, block_order: int, block_id: int>>"


def ingest_text(payloads: DataFrame) -> DataFrame:
    """``payloads(id, payload)`` to a page's text: its recognised texts, one a line, or, without any, its layout blocks by order, then id.

    Blank texts are left out; blocks without an order or id come last. Unreadable payloads give ''.
    """
    p = F.from_json("payload", LAYOUT)
    kept = lambda texts: F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")
    last = F.lit(1_000_000_000)
    blocks = F.array_sort(F.transform(p["blocks"], lambda b: F.struct(F.coalesce(b["block_order"], last).alias("o"), F.coalesce(b["block_id"], last).alias("i"), b["block_content"].alias("t"))))
    lines = F.coalesce(F.array_join(kept(p["rec_texts"]), "\n"), F.lit(""))
    return payloads.select("id", F.when(lines != "", lines).otherwise(F.coalesce(F.array_join(kept(F.transform(blocks, lambda b: b["t"])), "\n"), F.lit(""))).alias("text"))


def payload_errors(payloads: DataFrame) -> DataFrame:
    """Payloads with an error code."""
    code = F.from_json("payload", PAYLOAD)["errorCode"]
    return payloads.where(F.coalesce(code, F.lit(0)) != 0).select("id", code.cast("long").alias("error_code"))


ANGLES = "result struct<ocrResults: array<struct<prunedResult: struct<doc_preprocessor_res: struct<angle: double>>>>>"


def page_angle(payload: Column) -> Column:
    """The quarter turn that a payload's page was given before it was read: its first of 90, 180 and 270 degrees, else 0.

    Turns count modulo 360; an unreadable payload gives 0.
    """
    angles = F.transform(F.from_json(payload, ANGLES)["result"]["ocrResults"], lambda r: F.pmod(r["prunedResult"]["doc_preprocessor_res"]["angle"].cast("int"), F.lit(360)))
    return F.coalesce(F.try_element_at(F.filter(angles, lambda a: a.isin(90, 180, 270)), F.lit(1)), F.lit(0)).cast("long")


def restore_coordinates(tokens: DataFrame, angle: Column, width: Column, height: Column, source_width: Column | None = None, source_height: Column | None = None) -> DataFrame:
    """Boxes on a page as it was sent and stored: undo its counterclockwise turn, then its scaling.

    The page was ``width`` x ``height`` when sent, and turned by 90, 180 or 270
    degrees before it was read (other angles: not at all); it is stored in
    ``source_width`` x ``source_height``, the same size if not given. A null box stays null.
    """
    x0, y0, x1, y1 = (F.col(c) for c in ("left", "top", "right", "bottom"))
    across = F.lit(1.0) if source_width is None else source_width / width
    down = F.lit(1.0) if source_height is None else source_height / height
    turned = {
        "left": F.when(angle == 90, width - y1).when(angle == 180, width - x1).when(angle == 270, y0).otherwise(x0) * across,
        "top": F.when(angle == 90, x0).when(angle == 180, height - y1).when(angle == 270, height - x1).otherwise(y0) * down,
        "right": F.when(angle == 90, width - y0).when(angle == 180, width - x0).when(angle == 270, y1).otherwise(x1) * across,
        "bottom": F.when(angle == 90, x1).when(angle == 180, height - y0).when(angle == 270, height - x0).otherwise(y1) * down,
    }
    return tokens.withColumns(turned)
