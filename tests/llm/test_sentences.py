"""Sentence units: what is learned does not hang on the size of the collection, and no distance is bounded."""

import pytest

from rankmill.llm import sentences
from tests.llm.test_llm import MODEL


@pytest.mark.parametrize("gap", [1, 150, 250, 5000])
def test_long_gaps_and_tokens(gap):
    assert len(sentences.units("It was Dr." + " " * gap + "Quill who read the file.", MODEL)) == 1
    assert len(sentences.units("It is kept by approx. 3" + "x" * gap + ".py of the files.", MODEL)) == 1


def test_learned_the_same_from_copies(spark):
    """Ten copies of a collection give the same types: decisions rest on shares."""
    rows = [f"The list has approx. {i} rows in the file. It is read by Dr. Quill and then closed. Then the queue ends." for i in range(80)]
    one = sentences.learn(spark.createDataFrame([(t, "en") for t in rows], "text string, lang string"))
    ten = sentences.learn(spark.createDataFrame([(t, "en") for t in rows * 10], "text string, lang string"))
    assert one.abbreviations == ten.abbreviations and one.starters == ten.starters and one.bound == ten.bound
