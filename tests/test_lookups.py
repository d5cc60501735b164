"""The bounded queue, the gazetteer and the price bands against plain loops."""

import datetime

import numpy as np
import pytest

from kindred.operators import places as P
from kindred.operators import prices as R
from kindred.operators import queues as Q

from .test_register import norm


def offer(queue, events, most):
    """One event at a time. queue: k -> [priority, since, waiting, sources]."""
    away = []
    for at, k, priority, source in sorted(events):
        if not k or priority is None:
            continue
        if k in queue:
            queue[k][0] = min(queue[k][0], priority)
            queue[k][3].add(source)
        elif sum(q[2] for q in queue.values()) >= most and priority >= 2:
            away.append((at, k))
        else:
            queue[k] = [priority, at, True, {source}]
    return away


@pytest.mark.parametrize("most", [0, 7, 500])
def test_queue_in_rounds(spark, most):
    """Batches with names taken between them: the queue fills, empties a little and fills again."""
    rng = np.random.default_rng(most)
    have, queue, at = {}, spark.createDataFrame([], Q.EMPTY), 0
    for _ in range(3):
        events = [(at + i, [None, "", *(f"s{j}" for j in range(30))][int(rng.integers(32))], [0, 1, 2, 2, 2, 3, None][int(rng.integers(7))], f"src{int(rng.integers(3))}") for i in range(40)]
        at += 40
        away = offer(have, events, most)
        queue, got = Q.admit(queue, spark.createDataFrame(events, "at long, k string, priority int, source string"), most)
        assert sorted(map(tuple, got.collect())) == away
        queue, names = Q.take(queue, 3)
        queue = Q.written(queue, "queue")
        want = sorted((q[0], q[1], k) for k, q in have.items() if q[2])[:3]
        assert sorted((r.priority, r.since, r.k) for r in names.collect()) == want
        for _, _, k in want:
            have[k][2] = False
        assert sorted((r.k, r.priority, r.since, r.waiting, tuple(r.sources)) for r in queue.collect()) == sorted((k, q[0], q[1], q[2], tuple(sorted(q[3]))) for k, q in have.items())


def test_lookup(spark):
    places = [("Roscales de la Peña", "Palencia"), ("roscales de la peña", "Palencia"), ("Villa", "Zamora"), ("Villa", ""), ("Aldea", "Zamora"), ("Nueva", "Zamora"), ("Nada", "Zamora"), ("", "Zamora"), (None, "Fuera"), ("Villa", "Fuera"), ("Caída", "Zamora"), ("Ir", "Zamora"), ("Ir", None)]
    aliases = [("Nueva", "Media"), ("Vieja Antigua", "Media"), ("Nueva", "Nueva"), (None, "x")]
    gazetteer = [(1, "Roscales", "Palencia"), (2, "Roscales de Abajo", "Palencia (p.)"), (3, "Villalba", "Zamora"), (4, "VILLA", "Zamora"), (5, "Villa", "León"), (6, "Vieja", "Zamora"), (7, "Iruña", "Zamora"), (8, None, "Zamora"), (9, "Aldea", "León"), (10, "Caída", "Zamora"), (11, "Villa", "Zamora")]
    outages = [(None, "Fuera"), ("Caida", "zamora")]
    lookup = P.lookup(spark.createDataFrame(places, "place string, province string"), spark.createDataFrame(aliases, "k string, other string"), spark.createDataFrame(gazetteer, "loc_id long, name string, province string"), spark.createDataFrame(outages, "form string, province string"))
    got = {(r.place, r.province): tuple(r)[2:] for r in lookup.collect()}
    names = {"nueva": ["media", "vieja antigua"]}
    want = {}
    for place, province in set(places):
        k, prov = norm(place), norm(province)
        forms = [f for x in [k, *names.get(k, [])] for f in (x, x.split(" ")[0]) if f]
        asked = [f for f in forms if prov != "fuera" and (f, prov) != ("caida", "zamora")]
        hits = next(((f, h) for f in asked if (h := [i for i, n, of in gazetteer if norm(n) and norm(n).startswith(f) and prov in norm(of)])), None)
        want[place, province] = ("found", hits[0], len(hits[1]), min(hits[1])) if hits else ("unavailable" if prov == "fuera" or forms and not asked else "not_found", None, 0, None)
    assert got == want and {v[0] for v in want.values()} == {"found", "unavailable", "not_found"} and want["Nueva", "Zamora"][1] == "vieja"
    empty = [spark.createDataFrame([], d) for d in ("place string, province string", "k string, other string", "loc_id long, name string, province string", "form string, province string")]
    assert P.lookup(*empty).count() == 0


def test_prices(spark):
    catalogue = [("a", 1.0, 2.0), ("a", 1.5, None), ("a", 0.5, 3.0), ("c", None, 1.0)]
    overrides = [("a", 1380, 60, 9.0, 1.0), ("a", 30, 90, 4.0, 8.0), ("b", 600, 600, 5.0, 6.0), ("a", 100, 200, None, 99.0), ("a", -5, 2000, 99.0, 99.0), ("a", None, 5, 99.0, 99.0)]
    table = [("c", 7.0, 7.5), ("a", 0.1, 0.1)]
    times = ["2024-01-01 23:00:00", "2024-01-01 22:59:59", "2024-01-02 00:00:00", "2024-01-02 00:45:30", "2024-01-02 01:00:00", "2024-01-02 01:30:00", None]
    calls = [(i * 10 + j, m, None if t is None else datetime.datetime.fromisoformat(t)) for i, m in enumerate(["a", "b", "c", "d", None]) for j, t in enumerate(times)]
    frames = [spark.createDataFrame(catalogue, "model string, price_in double, price_out double"), spark.createDataFrame(overrides, "model string, start int, stop int, price_in double, price_out double"), spark.createDataFrame(table, "model string, t_in double, t_out double")]
    df = spark.createDataFrame(calls, "id long, model string, ts timestamp")

    def price(model, ts, which):
        good = [r[1 + which] for r in catalogue if r[0] == model and None not in r]
        for m, start, stop, *both in overrides:
            if m == model and None not in both and start is not None and 0 <= start < 1440 and 0 <= stop < 1440:
                minute = None if ts is None else ts.hour * 60 + ts.minute
                if minute is not None and (start <= minute < stop if stop > start else minute >= start or minute < stop):
                    good.append(both[which])
        return max(good) * 1.1 if good else next((r[1 + which] for r in table if r[0] == model), R.DEFAULT[which])

    got = {r.id: (r.price_in, r.price_out) for r in R.prices_at(df, *frames).collect()}
    assert got == {i: (price(m, t, 0), price(m, t, 1)) for i, m, t in calls}
    worst = {r.model: (r.price_in, r.price_out) for r in R.worst_prices(df, *frames).collect()}
    assert worst == {"a": (9.0 * 1.1, 8.0 * 1.1), "b": (5.0 * 1.1, 6.0 * 1.1), "c": (7.0, 7.5), "d": R.DEFAULT, None: R.DEFAULT}
    assert R.prices_at(df.where("false"), *frames).count() == 0
