import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import compare  # noqa: E402
from lectern.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    names, rows = compare.rows_of_spark(df)
    if name in registry.ORACLES:
        assert compare.kinds(df, con, registry.ORACLES[name]) == {}
        theirs = compare.rows_of_duck(con, registry.ORACLES[name])
        assert (names, rows) == theirs


def test_lesson_metadata_reads_conversations(spark):
    assert registry.QUERIES["lesson_metadata_all"](spark, SF).where("msg_id >= 0").count() > 0


def test_contexts_search_all_vectors_and_keep_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prompts = registry.QUERIES["augment_prompt_all"](spark, SF).collect()
    assert len(prompts) == len(texts) and all(r.prompt.endswith(texts[r.doc_id]) for r in prompts)
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6)
    best = {q: sorted(vectors, key=lambda v: (-dot(vectors[v], vectors[q]), v))[:6] for q in vectors if q % 50 == 0}
    want = {q: "\n\n".join(texts[v] for v in vs if v in texts) for q, vs in best.items()}
    assert {r.query_id: r.context for r in registry.QUERIES["rag_context_all"](spark, SF).collect()} == {q: t for q, t in want.items() if t}
