import numpy as np
import pytest

from quillspark.llm import source_mixing as sm

D = "doc_id long, text string, source string, lang string, tokens long, members string"
T = "mix_name string, source string, target_share double, max_repeats int"


def documents(n=300):
    rows = []
    for k in range(n):
        s = "big" if k % 10 else "small"
        rows.append((k, ("alpha beta gamma " if s == "big" else "delta epsilon zeta ") * (3 + k % 7), "Big " if k % 50 == 1 else s, "en", 0, "x"))
    return rows


def run(spark, rows, targets):
    mixture, report = sm.mix_sources(spark.createDataFrame(rows, D), spark.createDataFrame(targets, T))
    return [r.asDict() for r in mixture.collect()], {(r["mix_name"], r["source"]): r.asDict() for r in report.collect()}


def test_shares_and_caps(spark):
    rows = documents() + [(900, "delta epsilon zeta " * 9, None, "en", 0, "x"), (901, None, "big", None, 0, "x"), (902, "", "big", None, 0, "x")]
    mixture, report = run(spark, rows + rows[:1], [("even", "big", 0.5, 1), ("even", "small", 0.5, 4), ("gone", "big", 0.9, 2), ("gone", "none", 0.1, 2)])
    for s in ("big", "small"):
        assert report["even", s]["actual_share"] == pytest.approx(0.5, abs=0.02)
    assert report["even", "small"]["most_copies"] <= 4 and report["even", "big"]["most_copies"] == 1
    assert report["gone", "none"] | {} == {"mix_name": "gone", "source": "none", "target_share": 0.1, "actual_share": 0.0, "tokens": 0, "documents": 0, "most_copies": 0, "max_repeats": 2, "available": False, "fit_residual": 0.0}
    assert report["gone", "big"]["actual_share"] == 1.0
    assert len({(m["mix_name"], m["doc_id"]) for m in mixture}) == len(mixture)
    assert {m["source"] for m in mixture} == {"big", "small"}
    assert not {901, 902} & {m["doc_id"] for m in mixture}


def test_classifier_on_held_out_documents():
    rng = np.random.default_rng(1)
    make = lambda words, n: [" ".join(rng.choice(words, 12)) for _ in range(n)]
    a, b = make(["cell", "nucleus", "stain"], 60), make(["invoice", "price", "order"], 60)
    counts = np.zeros((2, sm.FEATURES))
    for k, texts in enumerate((a[:40], b[:40])):
        _, f, n = sm.trigram_counts(texts)
        np.add.at(counts[k], f, n)
    model = sm.SourceClassifier(["a", "b"], counts, np.array([40.0, 40.0]))
    p = model.posteriors(a[40:] + b[40:])
    assert (p[:20, 0] > 0.5).mean() > 0.9 and (p[20:, 1] > 0.5).mean() > 0.9
    assert np.allclose(p.sum(1), 1)


def test_descent_reaches_the_goals_with_soft_members(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(400):
        p = float(rng.uniform(0.05, 0.95)) if k % 2 else float(k % 4 == 0)
        rows.append((k, None if k % 2 else ("a" if p == 1.0 else "b"), int(rng.integers(50, 400)), [("a", p), ("b", 1 - p)]))
    members = spark.createDataFrame(rows, "doc_id long, source string, tokens long, members array<struct<name:string,p:double>>")
    plan = sm.fit_rates(members, spark.createDataFrame([("m", "a", 0.6, 3), ("m", "b", 0.4, 3)], T))
    assert len(plan.steps) < sm.MAX_ROUNDS and plan.residuals[0] <= sm.TOLERANCE
    mixture = {r["doc_id"]: r["copies"] for r in sm.copies(members, plan).collect()}
    got = {name: sum(mixture.get(d, 0) * tokens * dict(m)[name] for d, _, tokens, m in rows) for name in "ab"}
    assert got["a"] / sum(got.values()) == pytest.approx(0.6, abs=0.01)
    assert max(mixture.values()) <= 3


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sm, "MAX_SOURCES", 1)
    with pytest.raises(ValueError):
        run(spark, documents(20), [("m", "big", 1.0, 1)])


def test_empty_tables(spark):
    assert run(spark, [], [("m", "big", 1.0, 1)])[0] == []
    assert run(spark, documents(20), [])[0] == []


def test_token_counts_are_those_of_the_public_tokenizer():
    count = sm.encoder(sm.TOKENIZER)
    assert count(["", "hello hello", "细胞"])[0] == 0 and count(["hello"])[0] >= 1
    assert count(["x" * 10_000])[0] > 10
