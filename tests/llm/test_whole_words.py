"""The classifier's indicators see the whole of a long word."""

from regionspark.llm import nbsvm


def test_what_follows_in_a_long_word_counts():
    for head in ("a1" * 4, "a" * 64, "a1" * 40):
        assert set(nbsvm.indicators(head + "-B" * 50)) != set(nbsvm.indicators(head))
    assert nbsvm.shapes_of("a1" * 4 + "B-" * 6) == ["x9x9x9x9", "X-X-X-X-", "X-X-"]
    assert nbsvm.shapes_of("Word") == ["Xx"]
    assert nbsvm.shapes_of("日本語" * 100 + "1") == ["x9"]
