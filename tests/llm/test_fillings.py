from arbora.llm import bin_completion as bc


def test_an_exact_filling_does_not_end_the_search():
    assert bc.fillings(bc._Stock([6, 6, 5, 5, 2]), 12, 0) == [(6, 6), (5, 5, 2)]
