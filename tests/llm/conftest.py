import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "naïve", "Ωmega", "it's", "x<y", "a,b", "№5"]
    word = lambda: rng.choice(words) + rng.choice(["", "", "", ".", str(rng.randint(0, 60))])
    passage = " ".join(word() for _ in range(70))
    out = [" ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 20, 40, 80, 200]))) for _ in range(60)]
    for i in range(20):
        base = out[rng.randrange(60)].split(" ")
        if base:
            base[rng.randrange(len(base))] = word()
        out.append(" ".join(base))
    out += [out[5], out[5].replace(" ", "\n"), out[7] + "  ", "\t" + out[7], passage, "lead " + passage, passage + " tail end", word() + " " + passage[200:] + " " + word()]
    out += ["", "   \n\t", None, None, "one", "one", "One", "a b c", "a b c", "a a a a a a a a a a a a a a a a a a a a a a a a", ("abc " * 300).strip(), "a\x00b " * 30, "x" * 400, "line one here\n" * 30, "é" * 120 + " é́ \x1c mid\x85dle"]
    out += [" ".join(f"w{k}" for k in range(4000)) + " " + passage]
    return out


@pytest.fixture(scope="session")
def rows():
    texts = make_texts()
    sources = ["b", "a", None, "c", "a", "a"]
    return [(1000 + 7 * i if i % 2 else i, t, "en", sources[i % 6], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Null and repeated ids, repeated rows, and columns named like those that operators make."""
    few = [r for r in rows if len(r[1] or "") < 2000]
    extra = [(None, few[3][1], None, None, None), (None, few[4][1], None, None, None), (few[6][0], "another text under the same id, which goes on " * 3, None, "a", 1), few[9], few[9]]
    return spark.createDataFrame(few + extra, SCHEMA).selectExpr("*", "'k' as key", "1L as sid", "2L as size", "'z' as _keep", "true as kept", "0 as stand", "'q' as fp_a")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    marks = [(r[0], int(bool(r[1]) and "$" not in r[1]), int(bool(r[1]) and "Gamma" in r[1])) for r in rows]
    return spark.createDataFrame(marks + [(None, 1, 1), (rows[0][0], None, None)], "doc_id long, quality int, toxic int")
