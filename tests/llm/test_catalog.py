"""The queries against their SQL, or brute force where SQL has no words for them."""

import hashlib
import re

import corpus_pipeline
import pytest
from compare import compare, oracle_connection

import __spark_entry__ as e
from threadloom.llm import catalog
from threadloom.llm.common import read

FOLDER = "/root/testdata/sf0.001"
SAME = {**catalog.QUERIES, "pipeline": corpus_pipeline.run}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", [n for n in SAME if n in e.oracle_sql()])
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, name, SAME[name], e.oracle_sql()[name], FOLDER) is None


def test_all_queries_and_the_pipeline():
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in catalog.QUERIES}
    assert set(SAME) <= set(e.queries())


def test_stages_keep_the_columns_of_documents(spark):
    docs = read(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_quality_model_on_documents_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.1"
    scored = catalog.op1_quality_classifier(spark, folder).where("held_out")
    rows = scored.join(read(spark, folder, "labels"), "doc_id").select("quality", "score", "predicted").collect()
    good = sorted(r.score for r in rows if r.quality == 1)
    poor = sorted(r.score for r in rows if r.quality == 0)
    ahead = sum(sum(p < g for p in poor) for g in good) / (len(good) * len(poor))
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert len(rows) > 500 and ahead > 0.97 and right > 0.95


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fits:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


def test_pii_base_spans(spark):
    texts = {r.doc_id: r.text for r in read(spark, FOLDER, "documents").collect()}
    rows = catalog.op7_pii(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone")]
        assert set(base) <= set(filter(None, r.spans.split(",")))
