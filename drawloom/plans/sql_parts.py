"""SQL that several queries' checks share."""

from ..operators import settle as se
from .bridge import DRAWS, TICKETS

SIZE = 33
ORD = ", n AS (SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY issue_year, issue_seq) AS ord FROM draws)"
NUM = ORD + ", num AS (SELECT lottery, ord, unnest(front) AS num FROM n), dom AS (SELECT l.lottery, x.num FROM (SELECT DISTINCT lottery FROM draws) l, (SELECT unnest(range(1, 34)) AS num) x)"
FREQ = NUM + ", f AS (SELECT d.lottery, d.num, count(n.num) AS times FROM dom d LEFT JOIN num n ON n.lottery = d.lottery AND n.num = d.num GROUP BY ALL)"
CELLS = NUM + ", cells AS (SELECT n.lottery, n.ord, dom.num, CASE WHEN list_contains(n.front, dom.num) THEN 1 ELSE 0 END AS hit FROM n JOIN dom ON dom.lottery = n.lottery)"
CHI = "SELECT lottery, sum(times) AS n, count(*) - 1 AS df, sum(times * times) * count(*) / sum(times) - sum(times) AS chi, max(times) AS hi, min(times) AS lo, count(*) AS k FROM f GROUP BY lottery"
RULES = "rules(h, j, grade, amount) AS (VALUES " + ", ".join(f"({h}, {j}, {g}, {a})" for h, j, g, a in se.GRADES) + ")"
SETTLED = (
    f"WITH {DRAWS}, {TICKETS}, {RULES}, hit AS (SELECT t.*, d.lottery, d.k, d.draw_date, len(list_intersect(t.main, d.front)) AS h, len(list_intersect(t.bonus, d.back)) AS j FROM tickets t LEFT JOIN draws d ON d.k = t.draw_k), "
    "settled AS (SELECT ticket_id, batch, lottery, draw_k, strategy, tier, score, CASE WHEN k IS NOT NULL THEN hit.h END AS h, CASE WHEN k IS NOT NULL THEN hit.j END AS j, r.grade, CASE WHEN k IS NOT NULL THEN coalesce(r.amount, 0) END AS amount, "
    "CASE WHEN k IS NOT NULL THEN 'evaluated' WHEN date_diff('day', CAST(generated AS DATE), (SELECT max(draw_date) FROM draws)) > 14 THEN 'missed' ELSE 'pending' END AS status, draw_date "
    "FROM hit LEFT JOIN rules r ON r.h = hit.h AND r.j = hit.j AND hit.k IS NOT NULL), ev AS (SELECT * FROM settled WHERE status = 'evaluated') "
)
PRI = "CASE source WHEN 'official' THEN 1 WHEN 'agg' THEN 2 ELSE 3 END"
