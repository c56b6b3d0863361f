from voxlake.schemas import ID_CANDIDATES, TEXT_CANDIDATES
from voxlake.sources.columns import (
    detect_roles, detect_upload_roles, distinct_headers, find_column, label_from_path,
    longest_text_column, require_column,
)


def test_candidate_order_wins_over_column_order():
    assert find_column(["comment", "review"], TEXT_CANDIDATES) == 1
    assert find_column(["avis", "verbatim"], TEXT_CANDIDATES) == 1


def test_case_is_ignored_and_the_last_variant_wins():
    assert find_column(["TEXT", "x", "Text"], TEXT_CANDIDATES) == 2
    assert find_column(["Review_ID"], ID_CANDIDATES) == 0
    assert find_column(["foo"], ID_CANDIDATES) is None


def test_upload_variant_is_exact_and_falls_back_to_the_first_column():
    assert detect_upload_roles(["Text", "content", "comment"]) == {"text": 2, "id": None}
    assert detect_upload_roles(["a", "avis"]) == {"text": 0, "id": None}
    assert detect_upload_roles(["a", "index", "review"]) == {"text": 2, "id": 1}


def test_roles():
    assert detect_roles(["Platform", "Langue", "avis", "origin"]) == {
        "text": 2, "id": None, "source": 3, "lang": 1,
    }


def test_repeated_headers():
    assert distinct_headers(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]


def test_required_column_names_what_is_there():
    try:
        require_column(["a"], "b")
    except ValueError as e:
        assert "['a']" in str(e)
    else:
        raise AssertionError("accepted")


def test_labels():
    assert label_from_path("/data/bank_reviews_sample.csv") == "bank"
    assert label_from_path("/data/bank.v2.csv") == "bank.v2"
    assert label_from_path("/data/bank_a.v2.csv", until=".") == "bank_a"


def test_longest_text_column_prefers_the_first_on_ties(spark):
    df = spark.createDataFrame([("ab", "abcd", "wxyz"), (None, "abcd", "wxyz")], "a string, b string, c string")
    assert tuple(longest_text_column(df).first()) == ("b", 4.0)
    df = spark.createDataFrame([(None, "ab"), ("x", "ab")], "a string, b string")
    assert tuple(longest_text_column(df).first()) == ("a", 2.0)  # null counts as `nan`
