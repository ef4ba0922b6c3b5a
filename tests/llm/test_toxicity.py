"""The composed grammar step by step, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from docloom.llm import toxicity as t


def fired(text, insults=("idiot", "clown")):
    g = t.Grammar(dict.fromkeys(insults, 1.0))
    return {k: v for k, v in zip(t.FEATURES, g.features(text), strict=True) if v}


def test_clauses():
    assert fired("an idiot") == {"insult": 1}
    assert fired("You are an idiot") == fired("an idiot, you are") == {"aimed_insult": 1}
    assert fired("You. An idiot") == {"insult": 1}
    assert fired("you idiot clown") == {"aimed_insult": 2}
    assert fired("you idiot. a clown") == {"aimed_insult": 1, "insult": 1}
    assert fired("you are not an idiot") == {"negated": 1}
    assert fired("not in any way at all an idiot") == {"insult": 1}
    assert fired("He said they are idiot") == {"reported": 1}
    assert fired('a "clown" and a clown') == {"reported": 1, "insult": 1}
    assert fired("He said it. You clown") == {"aimed_insult": 1}
    assert fired("i will hurt you") == fired("I'll make you suffer") == fired("ich werde dich umbringen") == fired("we are going to murder you") == {"aimed_threat": 1}
    assert fired("you idiot i will hurt you") == {"insult_with_threat": 1}
    assert fired("je vais te tuer") == fired("te voy a matar") == fired("Ich werde dich bald töten") == {"aimed_threat": 1}
    assert fired("kill the process") == fired("you can kill this process") == fired("I will kill the process for you") == {}
    assert fired("i will never hurt you") == {"negated": 1}
    assert fired("never hurt anyone") == {"negated": 1}
    assert fired("") == fired("plain words only") == {}


def threatens(kinds):
    """A vow, or a speaker and then an intent without a person between; behind it a verb and a person, side by side (a person first: a word apart at most)."""
    for i, kind in enumerate(kinds):
        if kind == "vow":
            begin = i
        elif kind == "intent" and "speaker" in kinds[:i]:
            j = max(k for k in range(i) if kinds[k] == "speaker")
            if "target" in kinds[j:i] or "intent" in kinds[j:i]:
                continue
            begin = i
        else:
            continue
        rest = kinds[begin + 1 :]
        first = next(k for k in range(i, -1, -1) if k == 0 or kinds[k - 1] != "vow")  # of vows in a row
        if kind == "vow" and first and kinds[first - 1] == "target":
            rest = ["target", *rest]
        if "vow" in rest:
            rest = rest[: rest.index("vow")]
        for k in range(len(rest) - 1):
            if rest[k] == "threat" and rest[k + 1] == "target" or rest[k] == "target" and (rest[k + 1] == "threat" or rest[k + 2 : k + 3] == ["threat"]):
                return True
    return False


def brute(g, text):
    """Clause by clause, without a machine: scopes by counting words, patterns by what is left of a clause."""
    out, clause = dict.fromkeys(t.FEATURES, 0.0), []
    for token in [*t.WORD.findall(text), "."]:
        if token[0] not in ".!?;:\n":
            clause.append(token)
            continue
        negated, reported, held, weight, plain = 0, False, set(), 0.0, []
        for word in clause:
            kind, strength = g.symbol(word)
            kind = t.SYMBOLS[kind]
            if kind == "negation":
                negated, reported = 3, False
            elif kind in ("report", "quote"):
                reported, negated = not (reported and kind == "quote"), 0
            elif kind in ("insult", "threat") and (reported or negated):
                out["reported" if reported else "negated"] += strength or 1.0
                negated, kind = max(negated - 1, 0), "word"
            else:
                negated = max(negated - 1, 0)
                if kind in ("insult", "target"):
                    held.add(kind)
                    weight += strength
            plain.append(kind)
        whole = threatens(plain)
        name = ("insult_with_threat" if whole else "aimed_insult" if "target" in held else "insult") if "insult" in held else "aimed_threat" if whole else None
        if name:
            out[name] += weight or 1.0
        clause = []
    return [out[k] for k in t.FEATURES]


def test_features_equal_brute_force(spark, sf_dir):
    rng = random.Random(4)
    words = ["you", "idiot", "clown", "kill", "not", "said", '"', ".", "the", "go", "word", "murdering", "\n", "never", "i", "will", "i'll", "voy", "him"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(2000)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    g = t.Grammar({"idiot": 1.0, "clown": 0.5, "th": 0.1, "pathet*": 0.7})
    for text in texts:
        assert g.features(text) == pytest.approx(brute(g, text)), text[:200]


def test_labels_that_contradict_each_other_are_left_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    both = t.train(docs, labels.unionByName(labels.where("doc_id % 3 = 0").withColumn("toxic", 1 - labels.toxic)))
    without = t.train(docs, labels.where("doc_id % 3 <> 0"))
    assert both.insults == without.insults and np.array_equal(both.weights, without.weights)


HARMLESS = {
    "en": (["He {} the eggs until they are stiff", "They {} that CD for you", "You can {} this process with control c", "I {} him at chess", "She will {} the record and thank you", "We {} the paper, and you read it", "His knee made him {}"], ["beat", "burned", "kill", "suffer", "shoot", "hurt", "destroy"]),
    "de": (["Wir {} die Sahne, und du rührst", "Sie werden den Brief {}", "Er musste {}, weil ihr fehlt", "Ich {} ein Buch für dich vor", "Das Holz {} im Ofen, sagt er"], ["schlagen", "verbrennen", "leiden", "schlage", "verbrennt"]),
    "fr": (["Il faut {} à la porte chez vous", "Elle va {} le bois pour toi", "Nous allons {} le gâteau", "Ils aiment {} la pâte avec lui"], ["frapper", "brûler", "souffrir", "tuer", "massacrer"]),
    "es": (["Hay que {} la masa con él", "Ella va a {} el papel para ti", "Vamos a {} el tiempo juntos", "Quieren {} la leña con ustedes"], ["golpear", "quemar", "sufrir", "matar", "golpear bien"]),
}
THREATS = ["we are going to murder you", "I will kill you", "I'll make you suffer", "ich werde dich umbringen", "wir werden euch töten", "je vais te tuer", "nous allons vous frapper", "te voy a matar", "vamos a golpearte a ti, te voy a quemar"]


def test_threats_need_a_speaker_a_verb_and_a_person(spark):
    """Sentences with such verbs stay below 0.5, planted threats above, and no lone insult is worth more than an aimed one."""
    folder = "/root/testdata/sf0.1"
    g = t.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"))
    harmless = [f"{s.format(v)}{end}" for frames, verbs in HARMLESS.values() for s in frames for v in verbs for end in (".", " today. The rest is plain.")]
    rows = [(i, s) for i, s in enumerate(harmless)] + [(-1 - i, s) for i, s in enumerate(THREATS)]
    score = {r.doc_id: r.score for r in t.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), g).collect()}
    assert len(harmless) >= 200
    assert [s for i, s in rows if i >= 0 and score[i] >= 0.5] == []
    assert [s for i, s in rows if i < 0 and score[i] < 0.5] == []
    assert 0 <= g.weights[0] <= g.weights[1] <= g.weights[2]


def test_table_is_the_composition():
    move, fire = t.compose()
    for s in range(t.SCOPES):
        for c in range(t.HELD):
            for k, symbol in enumerate(t.SYMBOLS):
                assert divmod(int(move[s * t.HELD + c, k]), t.HELD) == (t._scope(s, symbol), t._clause(c, t._rewritten(s, symbol)))
                want = t._emit(s, c, symbol)
                assert fire[s * t.HELD + c, k] == (t.FEATURES.index(want) if want else -1)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in t.op5_toxicity(spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    found = np.mean([p for p, y in held if y == 1])
    false = np.mean([p for p, y in held if y == 0])
    # some documents labelled toxic have lost all such words to noise, or hold one that clean ones hold by chance
    assert found > 0.85 and false < 0.01, (found, false)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "idiot", "x"), (3, "idiot " * 50_000, "x"), (3, "idiot", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in t.score_toxicity(docs, t.train(docs, none)).collect())
    g = t.Grammar({"idiot": 1.0}, np.ones(len(t.FEATURES)), -1.0)
    got = t.score_toxicity(docs, g).collect()
    assert len(got) == 5 and t.score_toxicity(docs.limit(0), g).count() == 0
    assert {r.doc_id for r in got if r.score > 0.6} == {3}
