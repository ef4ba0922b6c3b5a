"""Toxicity: a weighted finite-state grammar over clauses.

Words are mapped to classes by a lexicon: insults (learned, with weights),
threats, targets, negations, reporting verbs, quotes and clause ends. Three
transducers read the classes from left to right and are composed into one table:

* scope: plain, negated (for a few words), or reported (until the clause ends);
* clause: whether the clause holds a target and an insult so far, and how far a
  threat has come: a speaker, who will, a verb of violence and a person beside it;
* emission: at a clause's end, the pattern that it matched - an insult aimed at a
  target or not, a whole threat, an insult with one; and where a scope takes a word
  out, that it was negated or reported. A verb of violence alone matches nothing.

A clause's weight is the summed strength of its insults, or one; a text has the
summed weights of its matched clauses by pattern, and no word counts alone. What
the patterns are worth is fitted on a bounded sample of labelled documents; the
lexicon of insults is learned from the same sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.vocab import by_bytes
from docloom.runtime import materialize, ship

TRAIN_ROWS = {1: 6_000, 0: 14_000}  # labelled documents that the grammar is fitted on, at most, by label
LEXICON = 2_000  # learned insult entries, at most
MIN_SUPPORT = 6  # toxic documents that an entry must occur in
STEMS = (5, 6, 7)  # letters of learned stems
MIN_RATIO = 40.0  # how much likelier an entry is in toxic documents

#: Closed classes of the grammar; ``*`` stands for any ending. Fixed values.
CLASSES = {
    "target": "you your yours he him she her they them du dich dir ihr euch er tu te toi vous lui ils tú usted ustedes él ella ellos".split(),
    "speaker": "i we ich wir je nous yo nosotros i'm we're".split(),
    "intent": "will gonna going shall werden".split(),
    "vow": "i'll we'll werde vais allons voy vamos".split(),
    "negation": "not no never isn't aren't don't won't nicht kein keine nie ne pas jamais sin nunca ni".split(),
    "report": "said says quoted wrote called allegedly reported sagte schrieb zitierte dit écrit cité dijo escribió citó".split(),
    "threat": (
        "kill* murder* hurt* destroy* beat* burn* punish* suffer* stab* shoot* strangl* töten tötet schlag* umbring* umgebracht erschie* verbrenn* leiden tuer tuera* frapper* brûler* "
        "massacr* étrangl* souffrir matar* golpear* quemar* sufrir* apuñal*"
    ).split(),
}

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]+|[\"“”«»]")

# States: scope (0 plain, 1..3 negated with so many words left, 4 reported) x stage of a threat x what the clause holds (bits: 1 target, 2 insult).
SCOPES, STAGES, HELD = 5, 8, 32
SYMBOLS = ["word", "insult", "threat", "target", "negation", "report", "end", "quote", "speaker", "intent", "vow"]
BITS = {"target": 1, "insult": 2}
FEATURES = ["insult", "aimed_insult", "insult_with_threat", "aimed_threat", "negated", "reported"]
NOTHING, SPEAKER, READY, VERB, OBJECT, OBJECT_AGO, AIMED, PERSON = range(STAGES)
STRONGEST = 1.2  # of an insult entry


def _scope(state: int, symbol: str) -> int:
    """The scope transducer."""
    if symbol == "negation":
        return 3
    if symbol in ("report", "quote"):
        return 0 if state == 4 and symbol == "quote" else 4
    if symbol == "end":
        return 0
    return state - 1 if 1 <= state <= 3 else state


def _rewritten(scope: int, symbol: str) -> str:
    """What the scope transducer passes on: negated and reported matches become plain words."""
    return "word" if scope and symbol in ("insult", "threat") else symbol


def _threat(stage: int, symbol: str) -> int:
    """How far a threat has come: someone (SPEAKER) who will (READY), a VERB and a person (OBJECT) side by side or a word apart."""
    if stage == AIMED:
        return AIMED
    if symbol == "vow":
        return OBJECT if stage in (PERSON, OBJECT) else READY  # as in: te voy a ...
    if stage in (NOTHING, SPEAKER, PERSON):
        if symbol == "target":
            return PERSON
        if symbol == "speaker" or stage == SPEAKER and symbol != "intent":
            return SPEAKER
        return READY if stage == SPEAKER else NOTHING
    if symbol == "threat":
        return AIMED if stage in (OBJECT, OBJECT_AGO) else VERB
    if symbol == "target":
        return AIMED if stage == VERB else OBJECT
    return OBJECT_AGO if stage == OBJECT else READY


def _clause(held: int, symbol: str) -> int:
    """The clause transducer: what was seen since the last end."""
    return 0 if symbol == "end" else _threat(held >> 2, symbol) << 2 | held & 3 | BITS.get(symbol, 0)


def pattern(held: int) -> str | None:
    """The pattern that a clause matches by what it holds."""
    whole = held >> 2 == AIMED
    if held & 2:
        return "insult_with_threat" if whole else "aimed_insult" if held & 1 else "insult"
    return "aimed_threat" if whole else None


def _emit(scope: int, held: int, symbol: str) -> str | None:
    """The feature that a symbol fires in a composed state: a clause's pattern at its end, or a word taken out by its scope."""
    if symbol == "end":
        return pattern(held)
    if symbol in ("insult", "threat") and scope:
        return "reported" if scope == 4 else "negated"
    return None


def compose() -> tuple[np.ndarray, np.ndarray]:
    """(next state, feature or -1) by state and symbol of the composed machine."""
    move = np.zeros((SCOPES * HELD, len(SYMBOLS)), np.int16)
    fire = np.full_like(move, -1)
    for scope in range(SCOPES):
        for held in range(HELD):
            for k, symbol in enumerate(SYMBOLS):
                move[scope * HELD + held, k] = _scope(scope, symbol) * HELD + _clause(held, _rewritten(scope, symbol))
                name = _emit(scope, held, symbol)
                fire[scope * HELD + held, k] = FEATURES.index(name) if name else -1
    return move, fire


@dataclass
class Grammar:
    """Lexicon and weights. ``insults``: word or stem to its strength."""

    insults: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    bias: float = -4.0

    def __post_init__(self):
        self.closed = {w: SYMBOLS.index(c) for c, ws in CLASSES.items() for w in ws}
        move, fire = compose()
        self.move, self.fire = move.tolist(), fire.tolist()
        self.still = (move[:, 0] == np.arange(len(move))).tolist()  # where a plain word changes nothing
        self.memo: dict[str, tuple[int, float]] = {}

    def symbol(self, token: str) -> tuple[int, float]:
        """Class of a token and, for insults, its strength."""
        head = token[0]
        if head in ".!?;:\n":
            return 6, 0.0
        if head in "\"“”«»":
            return 7, 0.0
        w = token.lower()
        strength = max([self.insults.get(x, 0.0) for x in (w, *stems(w))])
        if strength:
            return 1, strength
        return next((self.closed[x] for x in (w, *(w[:n] + "*" for n in range(len(w), 3, -1))) if x in self.closed), 0), 0.0

    def features(self, text: str) -> list[float]:
        """Summed weights of matched clauses by pattern, over the whole text; its end ends the last clause."""
        out = [0.0] * len(FEATURES)
        state, weight, memo, move, fire, still = 0, 0.0, self.memo, self.move, self.fire, self.still
        if len(memo) > 300_000:
            memo.clear()
        for token in WORD.findall(text):
            known = memo.get(token)
            if known is None:
                known = self.symbol(token)
                if len(token) <= 40:
                    memo[token] = known
            symbol, strength = known
            if not symbol and still[state]:
                continue
            k = fire[state][symbol]
            if symbol == 6:
                if k >= 0:
                    out[k] += weight or 1.0
                weight = 0.0
            elif k >= 0:
                out[k] += strength or 1.0
            else:
                weight += strength
            state = move[state][symbol]
        k = fire[state][6]
        if k >= 0:
            out[k] += weight or 1.0
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(features) @ self.weights + self.bias, -30, 30)))


def stems(word: str) -> list[str]:
    """A word's beginnings, marked by ``*``."""
    return [word[:n] + "*" for n in STEMS if len(word) > n]


def tokens_of(text: str) -> set[str]:
    """Distinct lower-case words and stems."""
    words = {t.lower() for t in WORD.findall(text) if t[0].isalpha()}
    return words.union(*map(stems, words))


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Words and stems that mark toxic documents, from ``labelled(text, toxic)``.

    Counted in Spark by documents; the LEXICON strongest are kept, by log ratio.
    An entry of which a stem is kept is dropped.
    """
    totals = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                found: Counter[str] = Counter()
                for text in batch.column("text").to_pylist():
                    found.update(tokens_of(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    # only what toxic documents hold often enough can get in, so the clean side is joined to that
    seen = labelled.where("toxic = 1").mapInArrow(spread, "word string, n long").groupBy("word").agg(F.sum("n").alias("t")).where(F.col("t") >= MIN_SUPPORT)
    other = labelled.where("toxic = 0").mapInArrow(spread, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    ratio = ((F.col("t") + 0.5) / (toxic + 1.0)) / ((F.coalesce("c", F.lit(0)) + 0.5) / (clean + 1.0))
    rows = seen.join(other, "word", "left").withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
    rows = rows.orderBy(F.desc(F.log("ratio") * F.sqrt("t")), "word").limit(LEXICON).collect()
    seen_in, ratios = {r.word: r.t for r in rows}, {r.word: r.ratio for r in rows}
    for word in sorted(ratios, key=len, reverse=True):  # a stem gives way to a purer entry that accounts for it
        for stem in stems(word.rstrip("*")) if word in ratios else ():
            if stem in ratios and ratios[word] > ratios[stem] and seen_in[word] >= 0.8 * seen_in[stem]:
                del ratios[stem]
    kept = {w: v for w, v in ratios.items() if not any(x in ratios for x in stems(w.rstrip("*")))}
    return {w: min(STRONGEST, (math.log(v) - 3) / 4) for w, v in kept.items()}


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, with a ridge.

    Weights of matched patterns aren't negative; an insult is worth no less where it is
    aimed, and again with a threat. Threats that fewer than MIN_SUPPORT toxic rows have
    are worth as much as the strongest insult aimed at someone.
    """
    supported = int(((x[:, 3] > 0) & (y == 1)).sum()) >= MIN_SUPPORT
    x = np.column_stack([np.log1p(x), np.ones(len(x))])
    theta = np.zeros(x.shape[1])
    ridge = np.full(len(theta), 0.05)
    ridge[-1] = 1e-4
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (y - p) - ridge * theta
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        theta = theta + np.linalg.solve(hess, grad)
        theta[:4] = np.maximum(theta[:4], 0)
        theta[:3] = np.maximum.accumulate(theta[:3])
    if not supported:
        theta[3] = theta[1] * np.log1p(STRONGEST) / np.log1p(1.0)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Lexicon and weights from at most TRAIN_ROWS whole documents, chosen by a hash of their id.

    ``labels(doc_id, toxic)``; rows with another or no label are left out, and so
    are documents labelled both ways. With
    no row of one of the labels, the grammar has no insults and scores are low.
    The chosen ids are few by the bound, so they are broadcast and texts are
    filtered where they are read.
    """
    spark = docs.sparkSession
    ship(spark)
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    rated = rated.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    parts = [rated.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for label, n in TRAIN_ROWS.items()]
    chosen = [tuple(r) for r in parts[0].unionByName(parts[1]).collect()]
    if len({label for _, label in chosen}) < 2:
        return Grammar({})
    sample = spark.createDataFrame(chosen, "doc_id long, toxic int")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = materialize(own.join(F.broadcast(sample), "doc_id").select("text", "toxic"))
    grammar = Grammar(learn_lexicon(labelled))
    data = np.array(sorted(tuple(r) for r in _features(labelled, grammar, ["toxic"]).collect()), dtype=float).reshape(-1, 1 + len(FEATURES))
    if grammar.insults and len(set(data[:, 0])) == 2:
        grammar.weights, grammar.bias = fit_weights(data[:, 1:], data[:, 0])
    return grammar


def _features(docs: DataFrame, grammar: Grammar, keep: list[str]) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                x = np.array([grammar.features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(x[:, i]) for i in range(len(FEATURES))], [*keep, *FEATURES])

    schema = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} double" for c in FEATURES]
    return docs.mapInArrow(emit, ", ".join(schema))


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, score (0 to 1) and the grammar's features.

    Null and empty texts fire nothing and get the score of no evidence. Repeated
    rows and null ids give a row each; other columns are ignored. No shuffle.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    found = _features(own, grammar, ["doc_id"])
    total = F.lit(float(grammar.bias))
    for name, weight in zip(FEATURES, grammar.weights, strict=True):
        total = total + F.log1p(name) * float(weight)
    return found.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-total))).alias("score"), *FEATURES)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: learn from rows that aren't held out, score every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    grammar = train(docs, labels.where(fold != 0))
    scored = score_toxicity(docs, grammar)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
