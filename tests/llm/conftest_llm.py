"""Small document tables and plain versions of what the operators share."""

from __future__ import annotations

import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: str | None) -> str:
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


VOCABULARY = "the of and river stone Über año light seven paper mountain green listen market window silver über harbour".split()


def prose(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(r.choice(VOCABULARY) + str(r.randint(0, 60)) * (r.random() < 0.6))
        if r.random() < 0.12:
            out[-1] += r.choice([".", "!", "?", ".\n", "\n"])
    return " ".join(out)


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Prose with exact and near copies, shared passages, repeated lines, empty, null and very long texts, and repeated rows."""
    r = random.Random(seed)
    passage = prose(r, 70)
    texts: list[str | None] = [prose(r, r.randint(1, 160)) for _ in range(n)]
    for i in range(0, n, 9):
        texts[i] = texts[(i + 5) % n]
    for i in range(1, n, 7):
        w = (texts[(i + 3) % n] or "").split(" ")
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = "edited" + str(r.randint(0, 9))
        texts[i] = " ".join(w)
    for i in range(2, n, 11):
        texts[i] = f"{prose(r, 30)}\n{passage}\n{prose(r, 30)}"
    texts[3], texts[4], texts[5], texts[6] = None, "", " \n\t ", "The. Of."
    texts[7] = "\n".join(prose(r, 25) for _ in range(40)) * 6
    texts[8] = "word " * 500
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), len(t) if t else None) for i, t in enumerate(texts)]
    return rows + [rows[10], rows[10]]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents")
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns named like those the operators make."""
    from pyspark.sql import functions as F

    names = "id node n key hi lo bands component kept n_words size taken h r runs lines start end first_id later _gone _doc".split()
    return docs.withColumns({name: F.lit(f"own {name}") for name in names})
