"""The pipeline's stages on the smallest tables, each against a plain version on what the stage before kept."""

import itertools

import corpus_pipeline as pipeline
from loglens.llm import packing, surrogates, toxicity
from loglens.llm.common import remainder, table
from loglens.llm.queries import REGISTRY, SURROGATE_KEY
from tests.llm.test_operators import brute_components, check_packed, plain_contamination, plain_fingerprint

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}

    model = toxicity.fit(docs, table(spark, SMALL, "labels"), lambda key: remainder(key, 4) != 2)
    dense = model.dense()
    clean = {i for i, t in texts.items() if model.score([(t or "").encode()], dense)[0][0] < toxicity.THRESHOLD}
    fps = {i: plain_fingerprint(texts[i]) for i in clean}
    roots = brute_components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    single = {i for i in clean if roots[i] == i}
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    free = {i for i, _, hit, _ in plain_contamination([(i, texts[i]) for i in single], items) if not hit}
    replace = surrogates.Surrogates(SURROGATE_KEY)
    made = {i: texts[i] and replace(texts[i])[0] for i in free}

    for (name, stage), want in zip(pipeline.STAGES, (clean, single, free, free)):
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} == want, name
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, None if t is None else len(t)) for i, t in made.items()}
    packed = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == free
    assert check_packed(packed, packing.CAPACITY) <= 1.02 * sum(r.length for r in packed) / packing.CAPACITY + 1
    assert len(clean) <= len(texts) and len(single) < len(clean) and len(free) < len(single)
    run = pipeline.run(spark, SMALL)
    assert run.count() == len(packed)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))
