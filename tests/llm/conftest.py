from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", str(rng.randrange(50))]) for _ in range(n))


TEXTS = [
    None, "", " \t\n", "one", "One  two", "one two", "ONE TWO", "a b c", "café \U0001f600 naïve 你好", "  x", "a" * 5000,
    "Mail x.y@mail.example.com, ip 10.0.0.300 and 192.168.1.1, card 4111 1111 1111 1111, call +1 (640) 555-0953!",
    'token = "592e2677e7e6567f917b8bfcceb4e5" 123-45-6789', "a@b.c%x@d.e 1.2.3.4.5.6.7.8 +12 4111-1111-1111-1112", "don't stop 12345  !!\n\n\tend ",
    prose(1, 40), prose(1, 40), prose(2, 3000), prose(3, 700), prose(3, 700) + " more", "!!! ### 123 …",
]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty and long texts, copies, a repeated row, a repeated id, a null id."""
    out = [(7 * i + 1, t) for i, t in enumerate(TEXTS)]
    return [*out, out[16], (out[15][0], "same id, other text"), (None, prose(1, 40)), (None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, fp long, score double, group string, kept boolean, spans string, start long, held_out string, key long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), 1, 2, 0.5, "g", True, "x", 3, "h", 4) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def broadcasts(df) -> int:
    """Broadcasts of the plan that was run for df's rows."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return plan.split("== Initial Plan ==")[0].count("BroadcastExchange")
