from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cleanframe.functions import booleans, dates, numbers, text
from cleanframe.functions.vocabulary import label
from cleanframe.operators.columns import snake_names


def test_strip_takes_every_unicode_space(apply):
    values = [" \t a b \n", " x ", "\x1cy\x1f", " z　", None, "  "]
    assert apply(text.strip, values) == [None if v is None else v.strip() for v in values]


def test_collapse_spaces(apply):
    assert apply(text.collapse_spaces, ["a \t b  c", " ", "a\x1c b"]) == ["a b c", " ", "a b"]


def test_title_case_follows_any_non_letter(apply):
    values = ["o'neil maria-josé 3rd", "ßa ﬁx", "", "ΣΑΣ", None, "x_y é"]
    assert apply(text.title_case, values) == [None if v is None else v.title() for v in values]


def test_strip_accents_of_single_and_several_characters(apply):
    values = ["São José", "ﬁ½", "Å", "x́y", "…", "plain", "", None, "한", "Ǆ", "ĳ“”€"]
    expected = [None if v is None else text.strip_accents_text(v) for v in values]
    assert apply(text.strip_accents, values) == expected
    assert expected[0] == "Sao Jose" and expected[1] == "fi1⁄2"


def test_strip_accents_jvm_only_leaves_ligatures(apply):
    assert apply(lambda c: text.strip_accents(c, single_only=True), ["ção ﬁ"]) == ["cao ﬁ"]


def test_remove_special_keeps_accented_letters(apply):
    assert apply(text.remove_special, ["ação! a.b,c@d-e_f #$1½", "(x)\t y"]) == ["ação a.b,c@d-e_f 1½", "x\t y"]


def test_null_spellings(apply):
    values = ["", "NA", " n/a ", "NaN", "NULL", "none", "-", "?", "Sem Dado", "nada", "0"]
    assert apply(text.null_spellings_to_null, values) == [None] * 9 + ["nada", "0"]


def test_text_step_is_idempotent(apply):
    def once(c):
        return text.standardise(c, case="title", accents=True, special=True)

    values = ["  josé  da SILVA! ", " - ", "a b"]
    first = apply(once, values)
    assert first == ["Jose Da Silva", None, "A B"]
    assert apply(once, first) == first


def test_null_spelling_made_by_later_steps(apply):
    # dropping special characters can leave a null spelling behind
    assert apply(lambda c: text.standardise(c, special=True), ["n!a", "#-#"]) == [None, None]


def test_parse_number_dot(apply):
    values = ["1.5", "1.234,56", "R$ 10", "12%", "1e3", "inf", "nan", "1.5d", "1_000", "", " 7 ", "+.5", "1.", "1,234.5", None]
    assert apply(lambda c: numbers.parse_number(c), values) == [
        1.5, None, 10.0, 12.0, 1000.0, None, None, None, None, None, 7.0, 0.5, 1.0, None, None,
    ]


def test_parse_number_comma(apply):
    values = ["1.234,56", "R$ 1.500,00", "-3,5%", "1.5", "abc"]
    assert apply(lambda c: numbers.parse_number(c, True), values) == [1234.56, 1500.0, -3.5, 15.0, None]


def test_parse_date(apply):
    values = [
        "1/2/2024", "31/12/2023", "12/31/2023", "2024-03-04", "2024/05/06", "5.6.2024", "02-30-2024", "x", "2024",
        " 1/2/2024 5:06 ", "2024-01-02T03:04:05.5", "31-04-2024", None,
    ]
    assert apply(dates.parse_date, values) == [
        datetime(2024, 2, 1), datetime(2023, 12, 31), datetime(2023, 12, 31), datetime(2024, 3, 4), datetime(2024, 5, 6),
        datetime(2024, 6, 5), None, None, None, datetime(2024, 2, 1, 5, 6), datetime(2024, 1, 2, 3, 4, 5, 500000), None, None,
    ]


def test_two_digit_years(apply):
    assert apply(dates.parse_date, ["05/06/24", "31.12.75 10:20", "1-2-76", "12/31/99", "5/6/4", "32/13/24"]) == [
        datetime(2024, 6, 5), datetime(2075, 12, 31, 10, 20), datetime(1976, 2, 1), datetime(1999, 12, 31), None, None,
    ]


def test_parse_date_month_first(apply):
    assert apply(lambda c: dates.parse_date(c, day_first=False), ["1/2/2024", "31/12/2023"]) == [
        datetime(2024, 1, 2), datetime(2023, 12, 31),
    ]


def test_dates_do_not_move_with_the_session_time_zone(spark, apply):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        # midnight of this day does not exist there
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        assert apply(dates.parse_date, ["04/11/2018"]) == [datetime(2018, 11, 4)]
        assert apply(lambda c: dates.parse_date_format(c, "dd/MM/yyyy"), ["04/11/2018", "2018-11-04"]) == [datetime(2018, 11, 4), None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_date_typed_by_user():
    assert dates.date_or_none("2/1/2024") == datetime(2024, 1, 2)
    assert dates.date_or_none("12/31/2023") == datetime(2023, 12, 31)
    assert dates.date_or_none("2024-01-02 03:04") == datetime(2024, 1, 2, 3, 4)
    assert dates.date_or_none("soon") is None


def test_parse_boolean(apply):
    values = ["Sim", " não ", "NAO", "S", "n", "1", "0", "yes", "No", "Verdadeiro", "falso", "true", "FALSE", "maybe", None]
    assert apply(booleans.parse_boolean, values) == [
        True, False, False, True, False, True, False, True, False, True, False, True, False, None, None,
    ]


def test_snake_names_are_unique():
    assert snake_names(["Nome Completo", "nome-completo", "  Ação (R$) ", "NOME__completo"]) == [
        "nome_completo", "nome_completo_2", "acao_r", "nome_completo_3",
    ]


def test_labels():
    assert label("média") == "mean" and label("mean") == "mean" and label("numérico") == "numeric"


@pytest.mark.parametrize("spelling, moment", [
    ("2024-01-02T10:00:00Z", datetime(2024, 1, 2, 10)), ("2024-01-02 10:00:00+02:00", datetime(2024, 1, 2, 8)),
    ("2024-01-02T22:30:00.5-0230", datetime(2024, 1, 3, 1, 0, 0, 500000)), ("12 Jan 2024", datetime(2024, 1, 12)),
    ("Jan 2, 2024", datetime(2024, 1, 2)), ("5 September 2023 07:08", datetime(2023, 9, 5, 7, 8)), ("20240102", datetime(2024, 1, 2)),
    ("02/01/2024 10:00 PM", datetime(2024, 1, 2, 22)), ("2024-01-02 12:15:00 am", datetime(2024, 1, 2, 0, 15)), ("2024-01-02 13:00 PM", None),
    ("2024-01-02 10:00:00.1234567", datetime(2024, 1, 2, 10, 0, 0, 123456)), ("01-12-2024", datetime(2024, 12, 1)), ("Janet 2, 2024", None), ("2024", None),
])
def test_date_spellings(spark, spelling, moment):
    df = spark.createDataFrame([(spelling,)], "v string")
    assert df.select(dates.parse_date(F.col("v"))).first()[0] == moment


def test_number_text(spark):
    wanted = [12345678.9, 0.00012, 1e-5, 1.5e-10, 1e16, 1.5e17, 123456789012345.0, 0.0, -0.5, -98765432.25, 1e7, 0.001, 5e-4]
    df = spark.createDataFrame([(v,) for v in wanted], "v double")
    assert [r[0] for r in df.select(numbers.number_text(F.col("v"))).collect()] == [repr(v) for v in wanted]
