"""Fill-in-middle: Elias-Fano lists, cuts against a plain version, edge cases, copies dealt to several tasks."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from varspan.llm import fim
from varspan.llm.queries import op11_fim

SCHEMA = "doc_id long, text string, n long, form string, output string, digest string, list int, ends int, copies int"


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60), st.integers(0, 10**6))
def test_elias_fano(values, room):
    values = sorted(values)
    data = fim.encode(np.array(values), values[-1] + room)
    assert [fim.select(data, i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.arange(1, 10001) * 40
    assert len(fim.encode(ends, 400_000)) < 10_000  # about 2 + log2(40) bits each


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "a\nb", "\n\n", "é\n😀x\n\n", "a\r\nb"])
def test_line_ends(text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert list(fim.line_ends(text)) == list(np.cumsum([len(x) for x in lines], dtype=int))


def plain_version(doc_id, text):
    """What the contract says, line by line."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [
    None, "", "\n", "one line", "two\nlines", "three\nlines\n\n", "mark <S> here\nx", "<P", "a<\n<P\nS>\n<M\n", "é😀\n" * 7 + "ß",
    "\n".join(f"line {i} of a long text" for i in range(30000)), "a\r\nb\rc\n", "copy\nof a\ntext\n", " \n\t\n ",
]


@pytest.fixture(scope="module")
def rows():
    found = [(100 * c + i, t) for c in range(3) for i, t in enumerate(TEXTS)]
    found += [(1000 + i, "copy\nof a\ntext\n") for i in range(200)]  # a large group of copies
    return found + [(None, "a\nb"), (None, None), (-5, "x\ny\nz"), (7, TEXTS[7]), (7, TEXTS[7])]


@pytest.mark.parametrize("copies", [fim.COPIES, 16])
def test_outputs(spark, rows, copies, monkeypatch):
    monkeypatch.setattr(fim, "COPIES", copies)
    docs = spark.createDataFrame([(*r, 1, "f", "o", "d", 1, 1, 1) for r in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, fim.fill_in_middle(docs).collect()), key=repr)
    assert got == sorted(((i, *plain_version(i, t)) for i, t in rows), key=repr)


def test_restored(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "f", "o", "d", 1, 1, 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in fim.op11_fim(docs).select("doc_id", "restored_sha256").collect()), key=repr)
    assert got == sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


def test_rates(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('a\\nb\\n', id) as text")
    forms = {r["form"]: r["count"] for r in fim.fill_in_middle(docs, seed=3, rate=50, spm_rate=20).groupBy("form").count().collect()}
    assert 150 < forms["plain"] < 250 and forms["psm"] > 2 * forms["spm"]


def test_collision(spark, monkeypatch):
    """Texts of one digest are told apart by their bytes."""
    monkeypatch.setattr(fim.F, "sha2", lambda column, bits, real=fim.F.sha2: real(fim.F.substring(column, 1, 2), bits))
    rows = [(i, t) for i, t in enumerate(["ab\nc", "ab\nd\ne", "ab\nc", "zz\n"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in fim.fill_in_middle(docs).collect()}
    assert got == {0: 2, 1: 3, 2: 2, 3: 1}


def test_empty(spark):
    assert fim.op11_fim(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_keeps_every_row(spark, sf):
    got = op11_fim(spark, sf)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
