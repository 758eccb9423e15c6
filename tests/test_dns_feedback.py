"""DNS feedback: windows of an hour share what they count, and each has its whole texts."""

import datetime as dt
import hashlib
import random
import re

from wardlog.functions.text import url_chars
from wardlog.operators.profiles import BLOCK
from wardlog.plans import feedback as P

START = dt.datetime(2024, 1, 1)
LOG = "src_ip string, logtime timestamp_ntz, end_time timestamp_ntz, dns_query string, dns_answer string"
VERDICTS = "feedback_id bigint, model_id int, src_ip string, start_time timestamp_ntz, end_time timestamp_ntz, feedback int"
HOST, LISTED = "10.0.1.5", ["b.net", "b.net", None, "c.d"]


def hour_of(t):
    return t.replace(minute=0, second=0, microsecond=0)


def clean(text):
    return re.sub("[^a-zA-Z.:,=&?$/]", "", text)


def made(n, verdicts, seed):
    """Events of three addresses in four hours and verdicts on windows, most of which end with an event."""
    rng = random.Random(seed)
    texts = ["a.com", "b.net", "b1.net", "c.d", "", None, "ä x.y", "9"]
    log = []
    for _ in range(n):
        t = START + dt.timedelta(minutes=rng.randrange(240))
        end = rng.choice([t, t + dt.timedelta(seconds=30), t + dt.timedelta(minutes=90), t, None if rng.random() < 0.1 else t])
        log.append((rng.choice([HOST, HOST, "10.0.2.7", "fe80::7", None]), t, end, rng.choice(texts), rng.choice(["1.2.3.4", "x", None])))
    log += log[:5]
    log += [("10.9.9.9", START, START, None, None), ("10.9.9.9", None, START, "a.com", "x")]
    ends = [r for r in log if r[0] and r[1] and r[2]]
    found = []
    for i in range(verdicts):
        ip, t, end, *_ = rng.choice(ends)
        found.append((i, 40, ip, hour_of(t), end, rng.choice([0, 1, 2, -1, None])))
    found += found[:3] + [(None, 40, HOST, hour_of(ends[0][1]), ends[0][2], 1), (900, 41, *found[0][2:]), (901, 40, None, *found[0][3:])]
    hour = dt.timedelta(hours=1)
    found += [(902, 40, HOST, START, START + 3 * hour, 1), (903, 40, HOST, START + hour / 2, ends[0][2], 1), (904, 40, HOST, START + hour, START, 1)]
    found += [(905, 40, "10.9.9.9", START, START, 1), (906, 40, HOST, None, START, 1), (907, 40, HOST, START, None, 1)]
    return log, found


def hashes(texts):
    sums = [sum(int(hashlib.md5(t.encode()).hexdigest()[s : s + 15], 16) for t in texts) for s in (0, 15)]
    return ":".join(map(str, sums))


def by_hand(log, verdicts):
    """Result rows and texts, each window compared with all events."""
    out, long = [], []
    for i, model, ip, start, end, verdict in verdicts:
        if model != 40 or verdict in (-1, None) or None in (ip, start, end):
            continue
        every = [r for r in log if r[0] == ip and r[1] and hour_of(r[1]) == start]
        mine = [r for r in every if r[2] and r[2] <= end]
        if not mine or max(r[2] for r in mine) != end:
            continue
        whole = max(r[2] for r in every if r[2]) == end
        row = [i, start, ip, end, len(mine), round(sum(r[3] in ("b.net", "c.d") for r in mine) / len(mine), 9), float(ip == HOST)]
        cells = []
        for place, column in ((3, "dns_query"), (4, "dns_answer")):
            texts = sorted(clean(r[place]) for r in mine if r[place] is not None)
            row += [len(texts), hashes(texts)]
            cells.append(" ".join(texts))
            long += [(i, start, ip, column, t, texts.count(t)) for t in set(texts)]
        row += cells + [float(whole and start.hour == h) for h in range(24)] + [float(whole and d == 1) for d in range(1, 8)]
        out.append((*row, verdict))
    return out, long


def of(rows, log, verdicts):
    domains = rows([(t,) for t in LISTED], "target string")
    ranges = rows([("10.0.1.0",), ("10.0.1.0",), (None,)], "range_start string")
    return P.dns_feedback(rows(log, LOG), rows(verdicts, VERDICTS), domains, ranges, 40)


def in_order(found):
    return sorted(found, key=repr)


def test_rows_and_texts_equal_those_of_each_window_alone(rows):
    log, verdicts = made(700, 6 * BLOCK, 1)
    out = of(rows, log, verdicts)
    want, long = by_hand(log, verdicts)
    first = ["feedback_id", "lgtime", "src_ip", "end_time", "cnt", "global_osint", "global_range"]
    texts = ["dns_query_texts", "dns_query_digest", "dns_answer_texts", "dns_answer_digest", "dns_query", "dns_answer"]
    assert out.rows.columns == [*first, *texts, *P.CLOCK, "feedback"]
    got = [(*r[:5], round(r[5], 9), *r[6:]) for r in map(tuple, out.rows.collect())]
    assert in_order(got) == in_order(want) and len(want) > 3 * BLOCK
    assert in_order(map(tuple, out.texts.collect())) == in_order(long)
    assert out.texts.columns == ["feedback_id", "lgtime", "src_ip", "column", "text", "n"]
    assert "dns_query" not in out.measures.columns and out.measures.count() == len(want)


def test_one_window_with_many_verdicts_and_no_verdicts(rows):
    log = [(HOST, START, START + dt.timedelta(seconds=i), f"q{i % 3}.com", "x") for i in range(5)]
    verdicts = [(i, 40, HOST, START, log[3][2], 1) for i in range(2 * BLOCK + 1)]
    want, _ = by_hand(log, verdicts)
    assert in_order(map(tuple, of(rows, log, verdicts).rows.collect())) == in_order(want) and len(want) == 2 * BLOCK + 1
    assert of(rows, log, []).rows.count() == 0 and of(rows, [], verdicts).rows.count() == 0


def test_events_are_counted_once_for_all_windows_of_an_hour(rows, monkeypatch):
    """Each event ends a window: events and windows both grow, the rows counted grow like the events."""
    counted, dns_counts = [], P.dns_counts

    def counting(log, *rest, **more):
        counted.append(log.count())
        return dns_counts(log, *rest, **more)

    monkeypatch.setattr(P, "dns_counts", counting)
    log = [(HOST, START, START + dt.timedelta(seconds=i), "a.com", "x") for i in range(400)]
    out = of(rows, log, [(i, 40, HOST, START, r[2], 1) for i, r in enumerate(log)])
    assert sum(counted) == len(log)
    assert [(r.cnt, len(r.dns_query)) for r in out.rows.orderBy("feedback_id").collect()] == [(i, 6 * i - 1) for i in range(1, 401)]


def test_no_shuffle_above_the_cells(spark, rows):
    log, verdicts = made(100, 20, 2)
    out = of(rows, log, verdicts).rows
    fields = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(fields)
    spark.conf.set(fields, "500")
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(fields, before)
    above = plan.split("concat_ws( , transform")[0]
    assert above != plan and "Exchange" not in above and "Join" not in above


def test_url_characters_without_patterns(rows):
    odd = ["", " ", None, "a.b/c?d=e&f$g:h,i", "ä€𝄞x́y", "\x00a\x00b\n\t", "99", "a-b_c[d]^e\\f", "𝄞𝄞", "İıſK"]
    df = rows([(i, t) for i, t in enumerate(odd)], "id int, t string").select("id", url_chars("t").alias("x"))
    assert {r.id: r.x for r in df.collect()} == {i: None if t is None else clean(t) for i, t in enumerate(odd)}
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
