"""The MATCH language, tested by texts that its grammar makes."""

import pytest
from hypothesis import assume, example, given
from hypothesis import strategies as st

from semql.operators.matchdsl import APPROXIMATE, EXACT, MOST, MatchError, MatchQuery, parse_match

BLANKS = st.text(" \t\n", max_size=3)
WORDS = st.text(st.characters(exclude_characters='/"', exclude_categories=["Cs"]), min_size=1, max_size=12).filter(lambda w: w.strip() == w)
SUFFIXES = st.one_of(
    st.just(("", APPROXIMATE, None)),
    st.just((f"/{APPROXIMATE}", APPROXIMATE, None)),
    st.just((f"/{EXACT}", EXACT, None)),
    st.tuples(st.sampled_from(["", "+", "0", "00"]), st.integers(1, 10**12)).map(lambda x: (f"/{APPROXIMATE}:{x[0]}{x[1]}", APPROXIMATE, min(x[1], MOST))),
)


@given(BLANKS, st.lists(WORDS, min_size=1, max_size=4), BLANKS, SUFFIXES, BLANKS)
def test_bare_queries(before, parts, gap, suffix, after):
    """Slashes inside are text as long as no mode follows the last one."""
    text, mode, candidates = suffix
    assume(text or parts[-1].split(":")[0] not in (APPROXIMATE, EXACT))
    query = "/".join(parts)
    assert parse_match(before + query + gap + text + after) == MatchQuery(query, mode, candidates)


@given(BLANKS, st.text(st.characters(exclude_characters='"', exclude_categories=["Cs"]), max_size=20), BLANKS, SUFFIXES, BLANKS)
def test_quoted_queries_are_kept_as_they_are(before, query, gap, suffix, after):
    text, mode, candidates = suffix
    assert parse_match(f'{before}"{query}"{gap}{text}{after}') == MatchQuery(query, mode, candidates)


@given(st.sampled_from([APPROXIMATE, EXACT]), st.data())
def test_modes_are_lower_case_and_whole(mode, data):
    changed = data.draw(st.sampled_from([mode.upper(), mode.title(), mode[:-1], mode + "s", " " + mode, mode[::-1]]))
    assert parse_match(f"some text/{changed}") == MatchQuery(f"some text/{changed}")
    with pytest.raises(MatchError):
        parse_match(f'"some text"/{changed}')


@given(st.text(st.characters(exclude_characters="/", exclude_categories=["Cs"]), max_size=6))
@example("")
@example("0")
@example("-1")
@example("1_000")
@example(" 7")
@example("+")
@example("2.5")
def test_candidate_counts_are_positive_integers(count):
    trimmed = count.rstrip()
    assume(not (trimmed.removeprefix("+").isascii() and trimmed.removeprefix("+").isdigit() and int(trimmed) > 0))
    for text in (f"q/{APPROXIMATE}:{count}", f'"q"/{APPROXIMATE}:{count}', f"q/{EXACT}:{count}", f"q/{EXACT}:5"):
        with pytest.raises(MatchError, match="^semql: "):
            parse_match(text)


@given(st.text(st.characters(exclude_characters='"', exclude_categories=["Cs"]), max_size=9), st.text(st.characters(exclude_characters='"/', exclude_categories=["Cs"]), min_size=1, max_size=5))
def test_quotes_end_and_nothing_else_follows(query, rest):
    assume(rest.strip() and rest.strip().split(":")[0] not in (APPROXIMATE, EXACT))
    for text in (f'"{query}', f'"{query}"{rest}', f'"{query}"/{rest}'):
        with pytest.raises(MatchError):
            parse_match(text)


@pytest.mark.parametrize("text", ["", "  ", '""', f"/{EXACT}", f' "" /{APPROXIMATE}:3'])
def test_queries_may_be_empty(text):
    assert parse_match(text).query == ""
