"""Queries do the whole job: cases that cuts once left out."""

import datetime

import pytest

from quillstone.operators import expansion as X
from quillstone.plans import expansion_queries, registry_queries, text_queries
from tests.conftest import rows


def saved(spark, at, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def expansion_folder(spark, at, links):
    return saved(
        spark, at, study_companies=([(i, f"C{i}", f"S{i}") for i in range(1, 5)], "company_id int, company string, lei string"),
        relationships=([(c, p, "IS_DIRECTLY_CONSOLIDATED_BY", "ACTIVE") for c, p in links], "child_lei string, parent_lei string, relationship_type string, relationship_status string"),
    )


def test_expansion_starts_from_every_studied_company(spark, tmp_path):
    d = expansion_folder(spark, tmp_path, [(f"X{i}", f"S{i}") for i in range(1, 5)])
    assert {r["identifier"] for r in expansion_queries.fixpoint_expansion(spark, d).collect()} == {f"{k}{i}" for k in "SX" for i in range(1, 5)}


def test_expansion_tells_what_it_lacks(spark, tmp_path, monkeypatch):
    d = expansion_folder(spark, tmp_path, [("X1", "S1"), *((f"X{i + 1}", f"X{i}") for i in range(1, 7))])
    with pytest.warns(UserWarning, match="MAX_ITERATIONS_REACHED"):
        expansion_queries.fixpoint_expansion(spark, d)

    def broken(frontier, n):
        raise ValueError("no answer")

    monkeypatch.setattr(X, "related_entities", lambda edges: broken)
    with pytest.raises(RuntimeError, match="registry.*no answer"):
        expansion_queries.fixpoint_expansion(spark, d)


def test_filing_days_without_hyphens_count(spark, tmp_path):
    day = datetime.datetime(2019, 6, 1)
    d = saved(
        spark, tmp_path, documents=([(1, "c", day), (2, "e", day)], "doc_id bigint, cik string, published_at timestamp"),
        edgar_subsidiaries=([("c", "a1", "20190301"), ("c", "a2", " 2019-03-01 "), ("c", "a3", "2019-03-01T10:00:00Z"), ("c", "a4", "20170301"), ("e", "a5", "20190301")], "cik string, accession string, filing_date string"),
    )
    assert rows(registry_queries.filings_before_document(spark, d)) == [(1, 3), (2, 1)]


def test_registry_names_vote_by_themselves(spark, tmp_path):
    text = "then Alpha & Beta's Gamma S.A. (\u201cABG\u201d) paid. Delta Works Ltd. slept; Nobody Known Inc. woke. It is Epsilon Zeta."
    names = ["ALPHA AND BETAS GAMMA S.A.", "Delta Works Ltd.", "Epsilon Zeta"]
    d = saved(
        spark, tmp_path, documents=([(1, text), (2, None)], "doc_id bigint, text string"),
        lei_entities=([(i, f"L{i}", x, "US", "ACTIVE") for i, x in enumerate(names)], "record_id bigint, lei string, legal_name string, legal_jurisdiction string, entity_status string"),
    )
    got = rows(text_queries.organization_vote(spark, d))
    assert [(r[1], r[2]) for r in got] == [("Alpha & Beta's Gamma S.A.", 3.25), ("Delta Works Ltd.", 2.0), ("Epsilon Zeta", 1.5)]
    assert rows(text_queries.alias_vote(spark, d)) == [(1, "ABG", "Alpha & Beta's Gamma S.A.")]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from quillstone import session

    conf = SimpleNamespace(get=lambda k, default=None: default)
    context = lambda master: SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None, master=master)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(SimpleNamespace(sparkContext=context(master), conf=conf))
    assert session.shared_dir(SimpleNamespace(sparkContext=context("local[4]"), conf=conf))
