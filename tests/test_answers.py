import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from netloom.sources.answers import AnswersReader, documents_in, field_at, read_answers

HITS = "pos long, id string, nation int, _source struct<severity: string, score: struct<base: double>>"


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")

    def put(place, *answers):
        (folder / place).parent.mkdir(exist_ok=True)
        (folder / place).write_text("\n".join(json.dumps(a) for a in answers), encoding="utf-8")

    def hit(k, severity):
        return {"id": f"é{k}", "more": [k], "_source": {"severity": severity, "score": {"base": k / 2}, "text": "x" * 50}}

    put("nation=1/a.json", {"hits": {"hits": [hit(k, "High" if k % 3 == 0 else "Low") for k in range(5000)]}})
    put("nation=2/a.json", {"hits": {"hits": [hit(0, "High"), None, 7, {"id": None}]}}, {"hits": {"hits": [hit(1, None)]}})
    put("nation=2/b.json", {"error": 1}, {"hits": None}, {"hits": {"hits": []}})
    put("nation=2/_left.json", {"hits": {"hits": [hit(9, "High")]}})
    put("nation=__HIVE_DEFAULT_PARTITION__/a.json", {"hits": {"hits": [hit(3, "High")]}})
    return str(folder)


def test_items_of_all_answers(spark, landed):
    rows = read_answers(spark, landed, HITS, "hits.hits").collect()
    assert len(rows) == 5004
    by_nation = {n: [r for r in rows if r.nation == n] for n in (1, 2, None)}
    assert [(r.pos, r.id, r._source and r._source.severity) for r in by_nation[2]] == [(0, "é0", "High"), (3, None, None), (0, "é1", None)]
    assert by_nation[None][0]._source.score.base == 1.5
    assert sorted(r.pos for r in by_nation[1]) == list(range(5000))
    assert read_answers(spark, landed, "id string").count() == 0  # another place: no list there


def test_terms_reach_the_answers(spark, landed):
    whole = read_answers(spark, landed, HITS, "hits.hits")
    some = read_answers(spark, landed, HITS, "hits.hits", {"_source.severity": ["High"], "nation": [1, 7]})
    assert sorted(r.pos for r in some.filter(F.col("_source.score.base") > 10).collect()) == list(range(21, 5000, 3))
    assert read_answers(spark, landed, HITS, "hits.hits", {"nation": [2], "id": ["é1"]}).count() == 1
    # what one query reads doesn't change what another reads of the same frame
    assert whole.filter("id = 'é1'").count() == 2 and whole.filter("id IS NULL OR id = 'é1'").count() == 3 and whole.count() == 5004
    assert whole.unionByName(whole.filter("nation = 2")).count() == 5007


def test_folders_are_left_out_and_small_files_share_a_task(landed):
    schema = _parse_datatype_string(HITS)

    def files(**more):
        parts = AnswersReader(schema, {"path": landed, "items": "hits.hits", **more}).partitions()
        return [[path.rsplit("/", 2)[1:] for path, _ in part.found] for part in parts]

    assert [len(p) for p in files()] == [4] and [len(p) for p in files(bytespertask="1")] == [1, 1, 1, 1]
    assert files(terms='{"nation": [2]}') == [[["nation=2", "a.json"], ["nation=2", "b.json"]]]
    assert files(terms='{"nation": [3]}') == [[]]
    for wrong in ('{"_source.score.base": [1]}', '{"pos": [1]}', '{"none": ["x"]}', '{"id": [null]}', '{"id": "x"}'):
        with pytest.raises(ValueError):
            files(terms=wrong)


def test_documents_in_a_text():
    assert list(documents_in(' {"a": 1}\n[2]{"b": "}"} \n')) == [{"a": 1}, [2], {"b": "}"}]
    assert list(documents_in("")) == [] and field_at({"a": [1]}, ("a", "b")) is None
    with pytest.raises(ValueError):
        list(documents_in('{"a": '))
