import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridia.functions import similarity as sim
from meridia.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("r")).first().r


CASES = [
    (text.base_text, "  São João d'Água-Fria  nº 3 ", "SAO JOAO D AGUA FRIA NO 3"),
    (text.base_text, None, ""),
    (text.base_text, "Straße Ærø Ñandú", "STRASSE AERO NANDU"),
    (text.base_text, "Jõao", "JOAO"),
    (text.join_leading_letters, "E M E F INSTITUTO", "EMEF INSTITUTO"),
    (text.join_leading_letters, "E INSTITUTO", "E INSTITUTO"),
    (text.join_leading_letters, "A B", "AB"),
    (text.join_trailing_letters, "COLEGIO PROF E M", "COLEGIO PROF EM"),
    (text.join_trailing_letters, "COLEGIO PROF E", "COLEGIO PROF E"),
    (text.school_name, "E.M.E.F. Profª Ana", "ESCOLA MUNICIPAL ENSINO FUNDAMENTAL PROFESSORA ANA"),
    (text.school_name, "EM Ana EM", "ESCOLA MUNICIPAL ANA EM"),
    (text.school_name, None, ""),
    (text.city_name, "Santa Bárbara d'Oeste", "SANTA BARBARA OESTE"),
    (text.person_name, "Maria da Silva e Souza", "MARIA SILVA SOUZA"),
    (text.name_core, "ESCOLA ESTADUAL PROFESSOR X SANTA LUZIA", "SANTA LUZIA"),
    (text.name_core, "ESCOLA ESTADUAL", "ESCOLA ESTADUAL"),
    (text.phonetic_fold, "BRAZOPOLIS", "BRASOPOLIS"),
    (text.phonetic_fold, "ITAPAJE", "ITAPAGE"),
    (text.phonetic_fold, "PHILLIPPE", "PILIPE"),
    (lambda c: text.digits_code(c, 7), "1234567.0", "1234567"),
    (lambda c: text.digits_code(c, 7), "12345", "0012345"),
    (lambda c: text.digits_code(c, 7), "123456789", None),
    (lambda c: text.digits_code(c, 7), "abc", None),
    (lambda c: text.padded(c, 7), "  ", None),
    (lambda c: text.padded(c, 3), "12345", "123"),
    (lambda c: text.full_match(c, r"\d{2}"), "12\n", False),
    (text.initials, "ana  maria", "A.M."),
    (text.capitalised, "ANA maria", "Ana maria"),
    (text.not_available_to_number, "5,4*", 5.4),
    (text.not_available_to_number, "ND***", None),
    (lambda c: text.any_pattern(c), "Etec de Lins", True),
    (lambda c: text.any_pattern(c), "Colégio Azul", False),
    (lambda c: F.concat_ws("|", *text.split_state(c, ("SP", "RJ"))), "Lins - SP", "Lins|SP"),
    (lambda c: F.concat_ws("|", *text.split_state(c, ("SP", "RJ"))), "Lins - XX", "Lins - XX"),
    (lambda c: F.array_join(text.number_tokens(c), ","), "CEF 24 CAMPUS III I", "24,III"),
]


def test_text_rules(spark):
    for f, value, want in CASES:
        assert one(spark, value, f) == want, (value, want)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_lcs_and_bounds(a, b):
    assert sim.lcs(a, b) == brute_lcs(a, b)
    for f in (sim.ratio, sim.token_sort, sim.token_set):
        assert 0 <= f(a, b) <= 100 and f(a, b) == pytest.approx(f(b, a))


def test_hand_computed_ratios():
    assert sim.ratio("", "") == 100
    assert sim.ratio("abcd", "bcde") == 75
    assert sim.token_sort("b a", "a b") == 100
    assert sim.token_set("PARQUE X", "PARQUE X II") == 100
    assert sim.token_set("", "A") == 0
    assert sim.token_set("a b", "a c") == pytest.approx(max(100 - 100 * 2 / 6, 100 - 100 * 2 / 4))


def test_columns(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r.r for r in df.select(sim.ratio_col("a", "b").alias("r")).collect()] == [75.0, None]
    assert len(one(spark, "x|y", sim.blake2b_64)) == 16
