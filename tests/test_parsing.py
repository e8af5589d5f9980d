"""Response parsing edge cases (J1-J10, semantics 1.3.1-1.3.4)."""

from pyspark.sql import functions as F

from tessera.operators import responses as R

VALID = '{"brief_reasoning": "r", "answer1": "Yes", "answer2": "No", "answer3": "No", "answer4": "No", "answer5": "No", "frequency": 2}'


def _q(spark, rows):
    df = spark.createDataFrame(rows, "id string, label string, response string")
    return {r["id"]: r for r in R.parse_questionnaire(df).collect()}


def test_questionnaire_failures_keep_rows(spark):
    rows = [
        ("ok", "a", VALID),
        ("prose", "a", "Sure, here it is: " + VALID),
        ("trunc", "a", VALID[:-1]),
        ("trailing", "a", VALID + " thanks"),
        ("nokey4", "a", VALID.replace('"answer4": "No", ', "")),
        ("lower", "a", VALID.replace('"Yes"', '"yes"')),
        ("many", "a", VALID.replace('"frequency": 2', '"frequency": "many"')),
        ("list", "a", "[1, 2]"),
        ("empty", "a", ""),
        ("nulls", "a", '{"brief_reasoning": null, "answer1": null, "answer2": "Yes", "answer3": "No", '
                       '"answer4": "No", "answer5": "No", "frequency": 1}'),
    ]
    out = _q(spark, rows)
    assert len(out) == len(rows)
    assert out["ok"]["error"] is None and out["ok"]["any_flag"] == 1 and out["ok"]["freq_num"] == 2.0
    for k in ("prose", "trunc", "trailing", "empty"):
        assert out[k]["error"] == "invalid json" and out[k]["answer1"] is None and out[k]["any_flag"] == 0
    assert out["list"]["error"] == "not an object"
    # fields before the missing key stay filled, later ones are NULL
    r = out["nokey4"]
    assert r["error"] == "missing key: answer4"
    assert r["answer3"] == "No" and r["answer4"] is None and r["answer5"] is None and r["frequency"] is None
    assert out["lower"]["answer1"] == "yes" and out["lower"]["any_flag"] == 0      # Yes is exact
    assert out["many"]["frequency"] == "many" and out["many"]["freq_num"] is None
    assert out["nulls"]["error"] is None and out["nulls"]["answer1"] is None and out["nulls"]["any_flag"] == 1


def test_rating_lists_last_wins_unknown_kept_text_null(spark):
    rows = [
        ("p1", 0, 'Here: [{"featureid": "a_X", "rating": 1}, {"featureid": "a_Y", "rating": "high"}] ok'),
        ("p1", 1, '[{"featureid": "a_X", "rating": 3}, {"featureid": "zz_Unknown", "rating": 2}, {"rating": 1}]'),
        ("p2", 0, '[{"featureid": "a_X", "rating": 1}, {"featureid": "a_X"'),   # truncated: dropped
        ("p3", 0, 'no list at all'),
    ]
    df = spark.createDataFrame(rows, "id string, cat_pos int, response string")
    out = {(r["id"], r["feature_id"]): r["rating"] for r in R.parse_ratings(df).collect()}
    assert out[("p1", "a_X")] == 3.0          # later category overwrites
    assert out[("p1", "a_Y")] is None         # non-numeric -> missing
    assert out[("p1", "zz_Unknown")] == 2.0   # unknown ids are kept
    assert not any(k[0] in ("p2", "p3") for k in out)


def test_comparisons_two_stage(spark):
    lst = '[{"Category": "Tone", "Post 1": "a", "Post 2": "b"}]'
    rows = [(1, lst), (2, lst + " Hope this helps."), (3, lst[:20]), (4, "Sure! " + lst)]
    df = spark.createDataFrame(rows, "pair_id int, response string")
    out = R.parse_comparisons(df).collect()
    assert sorted(r["pair_id"] for r in out) == [1, 2, 4]
    assert {r["category"] for r in out} == {"tone"}


def test_category_groups_plain_and_double_encoded(spark):
    import json
    doc = json.dumps({"categories": [{"name": f"Name{i}", "terms": [f"t{i}"]} for i in range(11)]})
    df = spark.createDataFrame([(doc,), (json.dumps(doc),)], "response string")
    got = R.parse_category_groups(df.limit(1), first_n=10).collect()
    got2 = R.parse_category_groups(df.subtract(df.limit(1)), first_n=10).collect()
    assert [r["name"] for r in got] == [f"name{i}" for i in range(10)]
    assert [(r["group_pos"], r["name"]) for r in got] == [(r["group_pos"], r["name"]) for r in got2]


def test_score_map_last_key_wins(spark):
    df = spark.createDataFrame([("p", '{"a": 1, "b": 2, "a": 3}'), ("q", "bad")], "id string, response string")
    out = {(r["id"], r["feature_name"]): r["score"] for r in R.parse_scores(df).collect()}
    assert out == {("p", "a"): 3.0, ("p", "b"): 2.0}


def test_definitions_and_feature_ids(spark):
    resp = ('text [{"featurename": "Help-seeking", "short_description": "d, with comma", "rating": "0-3"}, '
            '{"featurename": "Emotional tone", "short_description": "e", "rating": "0-3"}] end')
    df = spark.createDataFrame([("emotional state", resp)], "category string, response string")
    ids = [r["feature_id"] for r in R.parse_definitions(df).orderBy("pos").collect()]
    assert ids == ["emotionalstate_Help-seeking", "emotionalstate_Emotional_tone"]


def test_json_validity_matches_python(spark):
    import json
    from tessera.functions.parsing import json_valid
    cases = ["{'a': 1}", 'null', '{"a": "tab\there"}', '{"a": 1}}', '{"a":1}', '[1,2]', '{"a":1} x', '1] [2',
             'X}', '"s"', '{"a": 1}\n', '{"a": 1,}', '{"a": 01}', '', '{"a": [1, {"b": null}]}']

    def py(s):
        try:
            json.loads(s)
            return True
        except ValueError:
            return False
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(json_valid("t")).collect()]
    assert got == [py(c) for c in cases]
