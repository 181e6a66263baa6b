"""F10 active_on against a brute-force day-by-day check on random intervals."""
from datetime import date, datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.functions.exprs import active_on

BASE = date(2000, 1, 1)
D = date(2000, 3, 31)


def brute(created, delisted, p_start, p_end, d):
    if created > d:
        return False
    if delisted is not None and delisted <= d:
        return False
    if p_start is not None and p_start <= d and (p_end is None or p_end > d):
        return False
    return True


opt_day = st.one_of(st.none(), st.integers(0, 150))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 150), opt_day, opt_day, opt_day), min_size=1, max_size=40))
def test_active_on_matches_brute_force(spark, rows):
    def ts(n):
        return None if n is None else datetime.combine(BASE + timedelta(days=n), datetime.min.time()) + timedelta(hours=13)

    data = [(i, ts(c), ts(dl), ts(ps), ts(pe)) for i, (c, dl, ps, pe) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, created timestamp_ntz, delisted_timestamp timestamp_ntz, "
                                     "pause_started timestamp_ntz, pause_ended timestamp_ntz")
    got = {r.i for r in df.where(active_on(D)).select("i").collect()}

    def day(n):
        return None if n is None else BASE + timedelta(days=n)

    want = {i for i, (c, dl, ps, pe) in enumerate(rows) if brute(day(c), day(dl), day(ps), day(pe), D)}
    assert got == want
