from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st

from paperlode.functions.timestamps import BACK, BACK_YEAR, FORMAT, MONTH_FIRST, SWITCH, allowed, choose, ends, folded, norm, readings


def one(value, order=None, tz="UTC"):
    return norm(choose([allowed(readings(value), order)])[0], tz)


@pytest.mark.parametrize(
    ("value", "order", "tz", "want"),
    [
        ("05/04/2022", "DMY", "Asia/Kolkata", "2022-04-05"),
        ("05/04/2022", "MDY", "America/New_York", "2022-05-04"),
        ("01/01/22*", "MDY", "UTC", "2022-01-01"),
        ("०५/०४/२०२२", "DMY", "UTC", "2022-04-05"),
        ("5 Apr 2022", "DMY", "UTC", "2022-04-05"),
        ("April 5, 2022", "MDY", "UTC", "2022-04-05"),
        ("20220405", "DMY", "UTC", "2022-04-05"),
        ("1649116800", "DMY", "Asia/Kolkata", "2022-04-05T00:00:00.000000Z"),
        ("1649116800123", "DMY", "Asia/Kolkata", "2022-04-05T00:00:00.123000Z"),
        ("2022-04-05 10:00:00", "DMY", "Asia/Kolkata", "2022-04-05T04:30:00.000000Z"),
        ("05 Apr 2022, 10:00:00.250000", "DMY", "Asia/Kolkata", "2022-04-05T04:30:00.250000Z"),
        ("05-Apr-2022 10:00:00 EDT", "DMY", "UTC", "2022-04-05T14:00:00.000000Z"),
        ("Tue, 05 Apr 2022 10:00:00 +0530", "DMY", "UTC", "2022-04-05T04:30:00.000000Z"),
        ("05.Apr.2022 10:00 UTC-04:00", "DMY", "UTC", "2022-04-05T14:00:00.000000Z"),
        ("2022-04-05 10:00:00 Europe/London", "DMY", "Asia/Kolkata", "2022-04-05T09:00:00.000000Z"),
        ("05/04/2022 12:30 AM", "DMY", "UTC", "2022-04-05T00:30:00.000000Z"),
        # skipped and repeated local times take the offset before the change
        ("2022-03-27 01:30:00", "DMY", "Europe/London", "2022-03-27T01:30:00.000000Z"),
        ("2022-10-30 01:30:00", "DMY", "Europe/London", "2022-10-30T00:30:00.000000Z"),
        ("13/13/2022", "DMY", "UTC", None),
        ("31-Feb-2022", "DMY", "UTC", None),
        ("25 Xyz 2022", "DMY", "UTC", None),
        ("2022", "DMY", "UTC", None),
        ("", "DMY", "UTC", None),
        (None, "DMY", "UTC", None),
        ("x" * 5000, "DMY", "UTC", None),
    ],
)
def test_values(value, order, tz, want):
    assert one(value, order, tz) == want


def test_viterbi_takes_the_order_the_chain_bears_out():
    chain = [readings(v) for v in ("03/25/2022", "04/01/2022", "04/02/2022", "04/13/2022")]
    assert [r[1] for r in choose(chain)] == [date(2022, 3, 25), date(2022, 4, 1), date(2022, 4, 2), date(2022, 4, 13)]
    chain = [readings(v) for v in ("25/03/2022", "01/04/2022", "02/04/2022")]
    assert [r[1].month for r in choose(chain)] == [3, 4, 4]


def test_chain_with_gaps():
    assert choose([[], readings("nothing"), []]) == [None, None, None]
    assert choose([]) == []


@given(st.dates(date(2000, 1, 1), date(2035, 12, 31)), st.sampled_from(["%d/%m/%Y", "%d-%b-%Y", "%Y-%m-%d", "%d %B %Y", "%Y%m%d", "%d.%m.%y"]))
def test_round_trip(day, form):
    assert one(day.strftime(form), "DMY") == day.isoformat()


def test_periods():
    assert ends("01/04/2021 to 30/06/2021") == ("01/04/2021", "30/06/2021")
    assert ends("April 1, 2021 – March 31, 2022") == ("April 1, 2021", "March 31, 2022")
    assert ends("2021-04-01 - 2022-03-31") == ("2021-04-01", "2022-03-31")
    assert ends("as per ledger") is None and ends("to") is None and ends(None) is None


def test_values_of_any_length():
    v = "Wednesday, 11th September 2024, 12:34:56.123456789 p.m. America/Argentina/Buenos_Aires"
    assert norm(choose([readings(v)])[0], "UTC") == "2024-09-11T15:34:56.123456Z"
    assert readings("05/04/2022" + " " * 100_000) == readings("05/04/2022") and readings("5" * 100_000) == []


def test_the_order_in_force_outlives_other_formats():
    chain = [readings(v) for v in ("03/25/2022", "30 Mar 2022", "2022-03-31", "04/01/2022")]
    assert choose(chain)[-1][1] == date(2022, 4, 1)
    chain = [readings(v) for v in ("25/03/2022", *["30 Mar 2022"] * 500, "01/04/2022")]
    assert choose(chain)[-1][1] == date(2022, 4, 1)


def test_a_known_order_goes_before_the_chain():
    chain = [readings(v) for v in ("03/25/2022", "04/01/2022", "04/02/2022")]
    got = choose(chain, ["DMY"] * 3)
    assert got[0] is None and [r[1] for r in got[1:]] == [date(2022, 1, 4), date(2022, 2, 4)]
    assert [r[1] for r in choose(chain, ["MDY", "MDY", None])] == [date(2022, 3, 25), date(2022, 4, 1), date(2022, 4, 2)]


def test_both_sides_of_a_clock_change_are_readings():
    options = folded(readings("2022-10-30 01:30:00"), "Europe/London")
    assert len(options) == 2 and norm(options[1], "Europe/London") == "2022-10-30T01:30:00.000000Z"
    assert norm(choose([options])[0], "Europe/London") == "2022-10-30T00:30:00.000000Z"
    assert len(folded(readings("2022-10-30 03:30:00"), "Europe/London")) == 1


def brute(chain):
    """The cheapest path by trying all."""
    from itertools import product

    def cost(path):
        total = MONTH_FIRST * (path[0][1] == "mdy")
        for k, (r, order) in enumerate(path):
            if k:
                p, before = path[k - 1]
                total += SWITCH * (before != order) + FORMAT * (p[0] != r[0])
                step = p[1].toordinal() - r[1].toordinal()
                total += (BACK + BACK_YEAR * min(10.0, step / 365)) if step > 0.5 else 0
        return total

    states = [[(r, o) for r in options for o in ((r[0],) if r[0] in ("dmy", "mdy") else ("dmy", "mdy"))] for options in chain]
    return min(cost(p) for p in product(*states)), cost


@given(st.lists(st.sampled_from(["03/04/2022", "04/03/2022", "25/03/2022", "03/25/2022", "1 Apr 2022", "2022-03-30", "05/05/2022", "11/12/2021"]), min_size=1, max_size=6))
def test_viterbi_against_all_paths(values):
    chain = [readings(v) for v in values]
    best, cost = brute(chain)
    got = choose(chain)
    from itertools import product

    paths = product(*([(r, o) for o in ((r[0],) if r[0] in ("dmy", "mdy") else ("dmy", "mdy"))] for r in got))
    assert abs(min(cost(p) for p in paths) - best) < 1e-6
