"""Values searched in a page's tokens: all windows of the value's length over the joined text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import normalizers as n
from docloom.functions import similarity
from docloom.runtime import ship, spread


def token_stream(tokens: DataFrame) -> DataFrame:
    """Per page: its tokens' compact characters in order, and of each token its index, score and number of characters."""
    keyed = tokens.select("group_id", "token_index", compact_text(F.col("text")).alias("key"), "score")
    page = keyed.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("token_index", "key", "score"))).alias("t"))
    return page.select("group_id", joined_keys(F.col("t")).alias("stream"), key_parts(F.col("t")).alias("parts"))


def compact_text(text: Column) -> Column:
    """A token's compact characters; none if it has no text."""
    return F.coalesce(n.compact_key(text), F.lit(""))


def joined_keys(tokens: Column) -> Column:
    """The characters of a page's tokens ``(token_index, key, score)`` in order."""
    return F.array_join(F.transform(tokens, lambda x: x["key"]), "")


def key_parts(tokens: Column) -> Column:
    """Of each token its index, score and number of characters."""
    return F.transform(tokens, lambda x: F.struct(x["token_index"].alias("token_index"), x["score"].alias("score"), F.length(x["key"]).alias("n")))


def seeded_windows(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Windows of a page's text that may be near enough to a key, by seed and extension: (group_id, target, key, start, window).

    At a similarity of s, u = (1 - s) * size characters of the key at most, and as many
    of the window, are unmatched. Of 2 * u + 1 pieces of the key one is therefore in
    the window as it stands, u places from its own at most. Two characters of each
    piece are looked up in the page that its row meets, so only texts and keys are
    shuffled, never a page's positions; the windows around what is found are the
    candidates. Keys that allow no unmatched character have none.
    """
    size = F.length("key")
    loose = F.floor(F.when(size >= 8, 0.20).otherwise(0.16) * size + 1e-9).cast("int")
    sought = wanted.withColumn("u", loose).where("u > 0").distinct()
    met = sought.join(pages.where(F.length("stream") >= 2).select("group_id", "stream"), "group_id")
    u, last = F.col("u"), F.length("stream") - size + 1

    def starts(pairs: Column) -> Column:
        def of_piece(i: Column) -> Column:
            offset = F.floor(i * size / (2 * u + 1)).cast("int")
            at = n.once(F.substring(F.col("key"), offset + 1, F.lit(2)), lambda piece: F.filter(F.transform(pairs, lambda x, p: F.when(x == piece, p + 1 - offset)), lambda p: p.isNotNull()))
            return F.flatten(F.transform(at, lambda p: F.sequence(p - u, p + u)))

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), 2 * u), of_piece)))

    letters = F.split("stream", "")
    pairs = n.once(letters, lambda c: F.zip_with(F.slice(c, F.lit(1), F.length("stream") - 1), F.slice(c, F.lit(2), F.length("stream") - 1), lambda a, b: F.concat(a, b)))
    found = met.select("group_id", "target", "key", "stream", F.explode(F.filter(n.once(pairs, starts), lambda i: i.between(F.lit(1), last))).alias("start"))
    return found.select("group_id", "target", "key", "start", F.substring("stream", F.col("start"), size).alias("window"))


def search_rows(rows: DataFrame, shortest: int = 2) -> DataFrame:
    """The rows whose ``stream`` holds a window near enough to their ``key``, with what was found and the scores of its ``parts``.

    The most similar window, the earliest on ties. Near: similarity of 0.80 (0.84 for
    keys under 8 characters), and at most 3, 2 or 1 different characters for 12, 5 or
    fewer. An equal window needs no scoring, and a key of which too many characters are
    not in the text at all none. Else the windows that share enough characters with the
    key are scored, in the row where key and text have met: no window is ever shuffled.
    """
    ship(rows.sparkSession)
    key, stream, size = F.col("key"), F.col("stream"), F.length("key")
    need = F.when(size >= 8, 0.80).otherwise(0.84)
    met = rows.where((size >= shortest) & (F.length("stream") >= size)).withColumn("at", F.call_function("instr", stream, key))
    least = F.ceil(need * size - 1e-9).cast("int")
    present = size - F.length(F.call_function("translate", key, stream, F.lit("")))
    sought = (F.col("at") == 0) & (present >= least)
    met = met.withColumn("near", similarity.nearest_window(key, F.when(sought, stream), least))
    met = met.withColumns({"ratio": F.when(F.col("at") > 0, 1.0).otherwise(F.col("near.ratio")), "at": F.when(F.col("at") > 0, F.col("at")).otherwise(F.col("near.start"))})
    met = met.where(F.col("ratio") >= need).withColumn("found", F.substring("stream", F.col("at"), size))
    differ = F.aggregate(F.zip_with(F.split("key", ""), F.split("found", ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, v: a + v)
    most = F.when(size >= 12, 3).when(size >= 5, 2).otherwise(1)
    owners = F.flatten(F.transform("parts", lambda x: F.array_repeat(x["token_index"], x["n"])))
    good = met.where(differ <= most).withColumn("owned", F.array_distinct(F.slice(owners, F.col("at"), size)))
    score_of = lambda i: F.get(F.filter("parts", lambda x: x["token_index"] == i), 0)["score"]
    good = good.withColumn("known", F.filter(F.transform("owned", score_of), lambda s: s.isNotNull()))
    known = F.col("known")
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(known), F.lit(0))
    return good.select(*rows.columns, "found", F.round("ratio", 6).alias("similarity"), F.array_join(F.transform("owned", lambda i: i.cast("string")), ",").alias("owners"), F.round(mean, 6).alias("confidence"), F.round(F.array_min(known), 6).alias("weakest"))


FOUND = ["group_id", "target", "found", "similarity", "owners", "confidence", "weakest"]


def search_evidence(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (group_id, target): the window of the page's text that ``search_rows`` finds. Tokens and targets are shuffled once, to their page."""
    wanted = spread(targets.select("group_id", "target"), "group_id").distinct()
    met = wanted.withColumn("key", n.compact_key(F.col("target"))).join(token_stream(tokens), "group_id")
    return search_rows(met).select(FOUND)


def search_pages(pages: DataFrame) -> DataFrame:
    """As ``search_evidence`` for ``pages(group_id, tokens, targets)``, each row with all it needs: nothing is shuffled."""
    read = F.transform("tokens", lambda x: F.struct(x["token_index"].alias("token_index"), compact_text(x["text"]).alias("key"), x["score"].alias("score")))
    page = pages.where(F.size("targets") > 0).select("group_id", "targets", read.alias("t"))
    page = page.select("group_id", "targets", joined_keys(F.col("t")).alias("stream"), key_parts(F.col("t")).alias("parts"))
    met = page.select("group_id", "stream", "parts", F.explode(F.array_distinct("targets")).alias("target"))
    return search_rows(met.withColumn("key", n.compact_key(F.col("target")))).select(FOUND)
