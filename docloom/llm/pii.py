"""Personal data: generated candidate spans, boosted trees, calibrated thresholds.

High-recall patterns propose spans; a span becomes a row of format features
(length, kinds of characters, checks such as Luhn) and context features (the
characters and key words before it). Gradient-boosted trees score it; a span is
redacted where its score reaches its kind's calibrated threshold, or where it
passes the fixed base rules.

The main path is DataFrame functions only: the fitted trees become a column
expression. Each kind has trees and a threshold of its own, fitted on the driver
from a fixed set of made-up spans and a bounded sample of the corpus's candidates,
so corpora without any candidate are judged like others. Proposals of different
kinds may overlap.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize

SAMPLE_CANDIDATES = 4_000  # rows that the trees are fitted on, at most
ROUNDS, DEPTH, RATE = 12, 3, 0.4
CONTEXT = 24  # characters before a span that its features see, back to the match before it at most
PRECISION = 0.97  # asked of the threshold on the part of the sample kept for calibration

#: Base patterns by kind, as Java regular expressions. Possessive where giving
#: back can't help, so no text makes them backtrack or recurse; an email's first
#: part is only tried where it can begin (\\G: at the end of the match before).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)

#: High-recall generators of the added kinds, to be judged by the trees: long runs of key characters, values after
#: an assignment, bank accounts, and numbers in the form of national ids. They overlap.
#: A run is only tried where it begins.
SECRET = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}+"
GENERATORS = {
    "secret": SECRET,
    "assigned": r"(?<=[=:]\x20?[\"']?)[^\s\"',;<>=:\[\]]{6,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
ALL_KINDS = [*PATTERNS, *GENERATORS]

#: Words before a span that hint at a credential.
KEY_WORDS = r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth|bearer|credential)[\s\"':=]*$"


#: Words before a number that say whose or what it is.
ID_WORDS = r"(?i)(?:ssn|social security|national id|tax id|id number|iban|account|konto|cuenta|compte)[\s\"':=#.a-z]*$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits, from the right."""
    figures = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(figures, lambda v, i: F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The base rule of a kind for one match of its pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = lambda p: F.ltrim(p, F.lit("0"))
        small = lambda p: F.when(F.length(short(p)) <= 3, F.concat(F.lit("0"), short(p)).cast("int") <= 255).otherwise(False)
        return F.forall(F.split(match, r"\."), small)
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _runs(text: Column, pattern: str) -> tuple[Column, Column]:
    """(gaps, matches): the text is gap, match, gap, ..., gap."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# --- candidates and trees ---------------------------------------------------------------------

FEATURES = ["length", "digit_share", "upper_share", "lower_share", "hex", "classes", "distinct", "key_word", "assigned", "quoted", "access_key", "id_word", "check_sum", "mark_share"]


def _mod97(match: Column) -> Column:
    """Whether an account number passes its check: the country and check digits last, letters as 10 to 35, remainder 1."""
    x = F.replace(match, F.lit(" "))
    moved = F.filter(F.split(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, F.lit(1), F.lit(4))), ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.slice(moved, 1, 40), F.lit(0), lambda a, c: F.pmod(F.when(c.between("0", "9"), a * 10).otherwise(a * 100) + value(c), F.lit(97)).cast("int"))
    return F.when(x.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,31}$"), rest == 1).otherwise(False)


def features(kind: str, match: Column, before: Column) -> list[Column]:
    """Format and context features of a span, as doubles; those that say nothing of its kind are 0."""
    n = F.greatest(F.length(match), F.lit(1)).cast("double")
    share = lambda p: F.length(F.regexp_replace(match, p, "")).cast("double") / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        n, share("[^0-9]"), share("[^A-Z]"), share("[^a-z]"), flag(match.rlike("^[0-9a-f]+$")),
        flag(match.rlike("[0-9]")) + flag(match.rlike("[A-Z]")) + flag(match.rlike("[a-z]")),
        F.size(F.array_distinct(F.split(match, ""))).cast("double"),
        flag(before.rlike(KEY_WORDS)), flag(before.rlike(r"[=:]\s*[\"']?$")), flag(before.rlike(r"[\"']$")), flag(match.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$")),
        flag(before.rlike(ID_WORDS)) if kind in ("iban", "national_id") else F.lit(0.0), flag(_mod97(match)) if kind == "iban" else F.lit(0.0), share("[A-Za-z0-9]"),
    ]


@dataclass
class Trees:
    """An additive model: nodes as (feature, cut, left, right) or a leaf value; and a threshold."""

    base: float
    trees: list
    threshold: float

    def score(self, x: list[Column]) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            f, cut, left, right = node
            return F.when(x[f] <= cut, walk(left)).otherwise(walk(right))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + walk(t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum((_values(t, x) for t in self.trees), np.zeros(len(x))))))


def _values(node, x: np.ndarray) -> np.ndarray:
    """One tree's value for each row."""
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    left = x[:, node[0]] <= node[1]
    out = np.empty(len(x))
    out[left], out[~left] = _values(node[2], x[left]), _values(node[3], x[~left])
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """One regression tree by second-order gain."""
    leaf = float(RATE * g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best, whole = (1e-3, None, None), g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in values[:-1] if len(values) <= 32 else np.unique(np.quantile(values, np.linspace(0, 1, 33)[:-1])):
            left = x[:, f] <= cut
            if 0 < left.sum() < len(x):
                gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - whole
                if gain > best[0]:
                    best = gain, f, float(cut)
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1)


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost trees on two thirds of the rows; set the threshold on the rest.

    The threshold is the lowest score from which calibration precision is at
    least PRECISION, or one that no span reaches if there is none.
    """
    held = np.arange(len(y)) % 3 == 0
    xt, yt = x[~held], y[~held]
    base = float(np.log((yt.sum() + 0.5) / (len(yt) - yt.sum() + 0.5)))
    model, raw = Trees(base, [], 2.0), np.full(len(yt), base)
    for _ in range(ROUNDS if 0 < yt.sum() < len(yt) else 0):
        p = 1 / (1 + np.exp(-raw))
        model.trees.append(_grow(xt, yt - p, p * (1 - p), DEPTH))
        raw += _values(model.trees[-1], xt)
    scores, truth = model.predict(x[held]), y[held]
    seen = np.unique(scores)
    for lower, t in zip(np.append(0.0, seen), seen, strict=False):
        if truth[scores >= t].mean() >= PRECISION:
            model.threshold = float(max((lower + t) / 2, 0.5))  # half way to the next score below
            break
    return model


def seeds(kind: str) -> list[tuple[str, str, float]]:
    """Made-up spans of a kind: (match, what stands before it, 1 for personal data or a secret, else 0). Always the same."""
    rng = random.Random(kind)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    before = ["and then ", "see also ", "the file ", "path: ", "note: ", ""]
    keys = ["password=", "token: ", 'api_key="', "secret = '", "access-key: ", "Bearer "]
    out = []
    for i in range(120):
        plain, key = rng.choice(before), rng.choice(keys)
        if kind == "secret":
            out.append((pick(lower + upper + digits, rng.randrange(16, 48)) + rng.choice(digits), key, 1.0))
            out.append(("AKIA" + pick(upper + digits, 16), rng.choice([plain, key]), 1.0))
            out.append(("-".join(pick(lower, rng.randrange(4, 9)) for _ in range(4)) if i % 2 else pick(lower, rng.randrange(16, 40)), plain, 0.0))
            out.append((pick(upper, rng.randrange(16, 40)) if i % 2 else pick(upper, 1) + pick(lower, rng.randrange(15, 40)), plain, 0.0))
        elif kind == "assigned":
            out.append((pick(lower + upper + digits + "!@#$%.-_", rng.randrange(6, 30)) + rng.choice(digits), key, 1.0))
            out.append((pick(lower, rng.randrange(6, 14)), rng.choice(["note: ", "see: ", "title=", "it said: "]), 0.0))
            out.append(("//" + pick(lower, 6) + "." + pick(lower, 3) + "/" + pick(lower + digits, 5), "http:", 0.0))
        elif kind == "iban":
            body = pick(digits, 18)
            check = 98 - int(body + "".join(str(ord(c) - 55) for c in "DE") + "00") % 97
            good = f"DE{check:02d}{body}"
            out.append((good if i % 2 else " ".join(good[k : k + 4] for k in range(0, 22, 4)), rng.choice(["IBAN ", "account: ", plain]), 1.0))
            out.append((f"DE{(check + 1) % 97:02d}{body}", plain, 0.0))
        else:
            number = f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}"
            out.append((number, rng.choice(["SSN: ", "social security number ", "tax id "]), 1.0))
            out.append((number, rng.choice(["part no ", "call ", "item ", plain]), 0.0))
    return out


def train(docs: DataFrame) -> dict[str, Trees]:
    """Trees by kind, on the seeds and at most SAMPLE_CANDIDATES candidates of the corpus for each kind and label.

    There are no labels of spans. For ``secret`` and ``assigned``, a candidate
    with a digit counts as a credential if a key word and an assignment stand before it, or if
    it has the fixed form of an access key; words of letters count as none. For
    accounts the check digits decide, for national ids a word before them. All
    others are left out, and the trees carry the rule over to them by their form.
    One pass over the texts serves all kinds.
    """
    spark = docs.sparkSession

    def candidates(kind: str) -> Column:
        gaps, matches = _runs(F.col("text"), GENERATORS[kind])
        spans = F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.right(g, F.lit(CONTEXT)).alias("b"))), lambda s: s["m"].isNotNull())
        return F.when(_cheap(kind), spans).otherwise(F.expr("array()").cast("array<struct<kind:string,m:string,b:string>>"))

    m, b = F.col("m"), F.col("b")
    credential = (b.rlike(KEY_WORDS) & m.rlike("[0-9]")) | m.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$")
    word = ~m.rlike("[0-9]") | m.rlike("^[0-9-]+$")
    label = (
        F.when(F.col("kind") == "iban", F.when(_mod97(m), 1.0).otherwise(0.0)).when(F.col("kind") == "national_id", F.when(b.rlike(ID_WORDS), 1.0).otherwise(0.0))
        .when(credential, 1.0).when(word & ~b.rlike(KEY_WORDS), 0.0)
    )
    spans = docs.where(F.col("text").isNotNull()).select(F.explode(F.concat(*[candidates(k) for k in GENERATORS])).alias("s")).select("s.*").distinct().withColumn("y", label).where("y IS NOT NULL")
    chosen = Window.partitionBy("kind", "y").orderBy(F.xxhash64("m", "b"), "m", "b")  # the least of each group are taken before the shuffle
    sample = spans.withColumn("nth", F.row_number().over(chosen)).where(F.col("nth") <= SAMPLE_CANDIDATES // 2).drop("nth")
    made = spark.createDataFrame([(k, *x) for k in GENERATORS for x in seeds(k)], "kind string, m string, b string, y double")
    examples, models = materialize(sample.unionByName(made)), {}
    for kind in GENERATORS:
        rows = examples.where(F.col("kind") == kind).select("y", *[c.alias(f"f{i}") for i, c in enumerate(features(kind, m, b))]).collect()
        data = np.array(sorted(map(tuple, rows)), dtype=float).reshape(-1, len(FEATURES) + 1)
        data = data[np.argsort(np.arange(len(data)) * 7919 % len(data), kind="stable")]
        models[kind] = fit(data[:, 1:], data[:, 0])
    return models


def _cheap(kind: str) -> Column:
    """A quick test that a text may have a match of a kind at all."""
    text = F.col("text")
    tests = {
        "email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9]|[0-9][ -][0-9]"), "secret": text.rlike(SECRET),
        "assigned": F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "national_id": text.rlike("-[0-9]{2}-"),
    }
    return text.rlike("[0-9]") & tests[kind] if kind in ("ip", "card", "iban", "national_id") else tests[kind]


# --- the operator ---------------------------------------------------------------------------------


def _pattern(kind: str) -> str:
    return PATTERNS.get(kind) or GENERATORS[kind]


def _chosen(kind: str, models: dict[str, Trees], match: Column, gap: Column) -> Column:
    if kind in PATTERNS:
        return passes(kind, match)
    model = models[kind]
    # features are put into one array first, as every tree reads them again
    row = F.array(F.array(*features(kind, match, F.right(gap, F.lit(CONTEXT)))))
    score = F.transform(row, lambda x: model.score([x[i] for i in range(len(FEATURES))]))[0]
    return F.coalesce(score >= model.threshold, F.lit(False))


def find_spans(docs: DataFrame, models: dict[str, Trees] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, the number of spans of each kind as n_<kind>, base, spans.

    ``base`` and ``spans`` are strings of ``kind:start:end`` (code points, end
    exclusive), by start, then kind, joined by commas: those of the base rules,
    and all. Spans of the trees are of the kinds of GENERATORS; one that overlaps a
    base span is left out, and those of different kinds may overlap.

    Null and empty texts have no span. Repeated rows and null ids give a row
    each; other columns are ignored. Texts are never shuffled; matches are, by a
    row's own id, and each row's matches meet in one group, which its text bounds.
    """
    models = models or train(docs.select(F.col("text").cast("string").alias("text")))
    kinds = ALL_KINDS
    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = own.select("doc_id", F.monotonically_increasing_id().alias("row"), *[F.when(_cheap(k), F.struct(*[c.alias(n) for c, n in zip(_runs(F.col("text"), _pattern(k)), ("g", "m"), strict=True)])).alias(k) for k in kinds])

    def listed(i: int, kind: str) -> Column:
        pairs = F.zip_with(F.col(f"{kind}.g"), F.col(f"{kind}.m"), lambda g, m: F.struct(F.lit(i).alias("k"), F.length(g).alias("g"), F.length(m).alias("n"), F.when(m.isNotNull(), _chosen(kind, models, m, g)).alias("ok")))
        return F.transform(F.filter(pairs, lambda p: p["n"].isNotNull()), lambda p, at: F.struct(p["k"].alias("k"), at.alias("at"), p["g"].alias("g"), p["n"].alias("n"), p["ok"].alias("ok")))

    none = F.expr("array()").cast("array<struct<k:int,at:int,g:int,n:int,ok:boolean>>")
    lists = F.concat(*[F.coalesce(listed(i, k), none) for i, k in enumerate(kinds)])
    each = found.select("doc_id", "row", F.explode_outer(lists).alias("p"))
    each = each.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")  # few bytes, so their size is no guide
    along = Window.partitionBy("row", "p.k").orderBy("p.at")
    placed = each.select("doc_id", "row", F.col("p.k").alias("k"), F.col("p.ok").alias("ok"), F.col("p.n").alias("n"), F.sum(F.col("p.g") + F.col("p.n")).over(along).alias("stop"))
    placed = placed.withColumns({"start": F.col("stop") - F.col("n"), "is_base": F.col("ok") & (F.col("k") < len(KINDS))})
    ordered = Window.partitionBy("row").orderBy("start", "k")
    before = F.max(F.when(F.col("is_base"), F.col("stop"))).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("is_base"), F.col("start"))).over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    clash = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("stop"), F.lit(False))
    placed = placed.withColumn("free", F.col("ok") & (F.col("is_base") | ~clash))
    span = F.struct("start", "k", "stop")
    rows = placed.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("free"), span))).alias("all"))
    rows = rows.withColumn("base", F.filter("all", lambda s: s["k"] < len(KINDS)))
    named = F.array(*[F.lit(k) for k in kinds])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(named, s["k"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("all", lambda s: s["k"] == i)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(kinds)], joined("base").alias("base"), joined("all").alias("spans"))


def redact(docs: DataFrame, models: dict[str, Trees] | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, as ``[EMAIL]`` or ``[NATIONAL_ID]``.

    Kinds are replaced one after the other, base kinds first, so a later kind sees
    what earlier ones left: what ``find_spans`` reports is gone, and of candidates
    that overlap a base span the rest is judged anew. Nothing is shuffled. A null
    text stays null; other columns are kept, and repeated rows are treated alike.
    """
    models = models or train(docs.select(F.col("text").cast("string").alias("text")))
    out = docs.withColumn("text", F.col("text").cast("string"))
    for kind in ALL_KINDS:
        gaps, matches = _runs(F.col("text"), _pattern(kind))
        out = out.withColumn("text", F.when(_cheap(kind), F.array_join(F.zip_with(gaps, matches, _replacement(kind, models)), "")).otherwise(F.col("text")))
    return out


def _replacement(kind: str, models: dict[str, Trees]):
    """(gap, match) to the gap and the match, or its placeholder."""
    place = F.lit(f"[{kind.upper()}]")
    return lambda g, m: F.when(m.isNull(), g).otherwise(F.concat(g, F.when(_chosen(kind, models, m, g), place).otherwise(m)))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query: base counts and digest, and all spans, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
