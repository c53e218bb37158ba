"""Toxic terms in misspelled, related and joined forms."""

import random

from gridloom.llm import toxicity


def test_families_of_words_are_found_misspelled(spark):
    r = random.Random(5)
    plain = [f"{a}{b}{k}" for a in ("bar", "lin", "sto", "wen", "cra") for b in ("el", "ock", "um", "ith", "ora") for k in range(40)]
    rows = []
    for i in range(600):
        w = [r.choice(plain) for _ in range(30)]
        if i % 5 == 0:
            w[r.randrange(30)] = ("moron", "morons")[i // 5 % 2]
        rows.append((int(i % 5 == 0), " ".join(w)))
    words, stems = toxicity.mine(spark.createDataFrame(rows, "label int, text string"))
    assert any("moron".startswith(s) for s in stems) and {"moron", "morons"} <= set(words)
    lexicon = toxicity.FuzzyLexicon(words, stems)
    assert [lexicon.find(w)[1] for w in ("moron", "morons", "moronic", "m0ron", "m0rons", "nmoron")] == [0, 0, 0, 1, 1, 1]
    assert lexicon.find("barel3") is None
    assert all(lexicon.features(f"you {w} there")[0] > 0 for w in ("moron", "m0rons", "moronic"))


def test_terms_joined_by_marks_are_found():
    lexicon = toxicity.FuzzyLexicon({"idiot": 2.0, "moron": 2.0, "liar": 1.0}, {"stup": 1.5})
    found = lambda t: [(p, term, e) for p, term, e, _ in lexicon.hits(t)[0]]
    assert found("well you/idiot") == [(1, "idiot", 0)]
    assert found("liar,idiot!") == [(0, "liar", 0), (0, "idiot", 0)]
    assert found("stop—moron") == [(0, "moron", 0)]
    assert found("an idiot's idea") == [(1, "idiot", 0)]
    assert found("so_stupid the-stupidity") == [(0, "stup", 0), (1, "stup", 0)]
    assert found("id*ot") == found("i*diot") == [(0, "idiot", 1)]
    assert found("moron,id*ot/m*ron") == [(0, "moron", 0), (0, "idiot", 1), (0, "moron", 1)]
    assert found("plain-words/with,marks ... --") == []
    assert [h[3] for h in lexicon.hits('he said "you/idiot" again')[0]] == [True]


def test_the_lexicon_is_the_same_under_any_partitioning(spark):
    """Rows that share their four smallest word hashes count once, whichever comes first."""
    import random

    rng = random.Random(12)
    common = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omega".split()
    rows = [(k % 2, " ".join(common + [rng.choice(["idiot", "moron", "fool", "clown"]) if k % 2 else "kind", f"w{k % 9}"])) for k in range(200)]
    rows += [(k % 2, " ".join(rng.sample(common, 5) + (["idiot"] if k % 2 else ["thanks"]))) for k in range(200)]
    found = []
    for parts in (1, 7):
        rng.shuffle(rows)
        found.append(toxicity.mine(spark.createDataFrame(rows, "label int, text string").repartition(parts)))
    assert found[0] == found[1] and found[0][0]
