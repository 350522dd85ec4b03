"""SQL common table expressions for the oracle twins, written apart from the Spark views."""

from __future__ import annotations

from scorebook.plans.views import RESULTS

_TEXTS = ", ".join(f"'{r}'" for r in RESULTS)

PLAYS = f"""
plays AS (
  SELECT event_id, ts, 'cl' || strftime(ts, '%Y%m%d') || '01' AS game_id,
         '中日' AS visitor, 'DeNA' AS home,
         CAST(hour(ts) // 3 AS INT) + 1 AS inning_no,
         user_id % 2 = 0 AS is_top,
         CAST(user_id % 9 + 1 AS INT) AS slot,
         'u' || CAST(user_id AS VARCHAR) AS name,
         ([{_TEXTS}])[CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % {len(RESULTS)} + 1] AS result
  FROM events
)"""


def _has(*markers: str) -> str:
    return "(" + " OR ".join(f"result LIKE '%{m}%'" for m in markers) + ")"


# The rules as nested conditions, the way the play log is read one text at a time.
LITERAL = f"""
CASE WHEN {_has('安', '二', '三', '本')} THEN
       CASE WHEN {_has('二')} THEN 'H2' WHEN {_has('三')} THEN 'H3' WHEN {_has('本')} THEN 'HR' ELSE 'H1' END
     WHEN {_has('四球', '死球', '敬遠')} THEN CASE WHEN {_has('四球', '敬遠')} THEN 'BB' ELSE 'HBP' END
     WHEN {_has('犠飛')} THEN 'SF'
     WHEN {_has('ゴ', '飛', '振', '直', '斜', '失', '野選')} THEN 'OUT'
     ELSE 'NONE' END"""

CLASSED = PLAYS + f""",
classed AS (SELECT *, {LITERAL} AS cls FROM plays),
counted AS (
  SELECT *,
    CASE WHEN cls IN ('H1', 'H2', 'H3', 'HR', 'OUT') THEN 1 ELSE 0 END AS ab,
    CASE WHEN cls IN ('H1', 'H2', 'H3', 'HR') THEN 1 ELSE 0 END AS h,
    CASE cls WHEN 'H1' THEN 1 WHEN 'H2' THEN 2 WHEN 'H3' THEN 3 WHEN 'HR' THEN 4 ELSE 0 END AS tb,
    CASE WHEN cls = 'HR' THEN 1 ELSE 0 END AS hr,
    CASE WHEN cls = 'BB' THEN 1 ELSE 0 END AS bb,
    CASE WHEN cls = 'HBP' THEN 1 ELSE 0 END AS hbp,
    CASE WHEN cls = 'SF' THEN 1 ELSE 0 END AS sf
  FROM classed
)"""

BATTERS = """
batters AS (
  SELECT p_brand AS team, p_partkey AS name,
    CASE WHEN p_size % 7 = 0 THEN '不明' WHEN p_size % 3 = 0 THEN '右打' WHEN p_size % 3 = 1 THEN '左打' ELSE '両打' END AS hand,
    count(*) AS ab,
    count(*) FILTER (l_returnflag = 'R') AS h,
    count(*) FILTER (l_returnflag = 'R' AND l_quantity BETWEEN 41 AND 45) AS triples,
    count(*) FILTER (l_returnflag = 'R' AND l_quantity > 45) AS hr,
    count(*) FILTER (l_returnflag = 'R') + 2 * count(*) FILTER (l_returnflag = 'R' AND l_quantity BETWEEN 41 AND 45)
      + 3 * count(*) FILTER (l_returnflag = 'R' AND l_quantity > 45) AS tb,
    count(*) FILTER (l_returnflag = 'A' AND l_linenumber <= 2) AS sb,
    count(*) FILTER (l_returnflag = 'N' AND l_linenumber = 1) AS bb,
    count(*) FILTER (l_returnflag = 'N' AND l_linenumber = 7) AS hbp,
    count(*) FILTER (l_returnflag = 'N' AND l_linenumber = 6) AS sf
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY p_brand, p_partkey, p_size
)"""

RATES = BATTERS + """,
rated AS (
  SELECT *,
    CASE hand WHEN '左打' THEN 1 WHEN '両打' THEN 2 ELSE 0 END AS hand_code,
    h / greatest(ab, 1) AS avg,
    (h + bb + hbp) / greatest(ab + bb + hbp + sf, 1) AS obp,
    tb / greatest(ab, 1) AS slg
  FROM batters
),
typed AS (
  SELECT *, obp + slg AS ops, obp - avg AS isod,
    CAST(hr > 3 OR slg > 0.60 AS INT) AS type_power,
    CAST(avg > 0.33 AS INT) AS type_avg,
    CAST(sb > 4 OR triples > 2 AS INT) AS type_speed,
    CAST(obp - avg > 0.05 AS INT) AS type_eye
  FROM rated
),
players AS (
  SELECT *, CAST(type_power + type_avg + type_speed + type_eye >= 3 AS INT) AS type_all FROM typed
)"""

SHARES = """
sold AS (
  SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
),
shares AS (
  SELECT l_suppkey % 12 AS team, l_suppkey AS name, p_type AS pitch_type,
    n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY l_suppkey) AS share
  FROM sold
),
wide AS (
  SELECT team, name,
    coalesce(max(share) FILTER (pitch_type = 'ECONOMY'), 0.0) AS "pitch_ECONOMY_share",
    coalesce(max(share) FILTER (pitch_type = 'LARGE'), 0.0) AS "pitch_LARGE_share",
    coalesce(max(share) FILTER (pitch_type = 'MEDIUM'), 0.0) AS "pitch_MEDIUM_share",
    coalesce(max(share) FILTER (pitch_type = 'PROMO'), 0.0) AS "pitch_PROMO_share",
    coalesce(max(share) FILTER (pitch_type = 'SMALL'), 0.0) AS "pitch_SMALL_share",
    coalesce(max(share) FILTER (pitch_type = 'STANDARD'), 0.0) AS "pitch_STANDARD_share"
  FROM shares GROUP BY team, name
)"""

PITCHERS = SHARES + """,
pitchers AS (
  SELECT w.team, w.name,
    CASE WHEN s_nationkey % 2 = 0 THEN 0 ELSE 1 END AS hand,
    r.era, r.k9, r.hr9,
    "pitch_LARGE_share" + "pitch_PROMO_share" AS fast_group,
    "pitch_MEDIUM_share" + "pitch_SMALL_share" AS breaking_group,
    "pitch_STANDARD_share" + "pitch_ECONOMY_share" AS falling_group
  FROM wide w
  JOIN supplier ON w.name = s_suppkey
  JOIN (
    SELECT l_suppkey,
      count(*) FILTER (l_returnflag = 'R') * 9.0::DOUBLE / count(*) AS era,
      count(*) FILTER (l_returnflag = 'A') * 9.0::DOUBLE / count(*) AS k9,
      count(*) FILTER (l_returnflag = 'R' AND l_quantity > 45) * 9.0::DOUBLE / count(*) AS hr9
    FROM lineitem GROUP BY l_suppkey
  ) r ON r.l_suppkey = w.name
)"""

ENTRIES = """
entries AS (
  SELECT l_orderkey AS game_id, l_linestatus AS team, CAST(sum(l_quantity) AS BIGINT) % 10 AS runs
  FROM lineitem GROUP BY l_orderkey, l_linestatus
)"""

LINEUP = """
ordered AS (
  SELECT l_orderkey AS game_id, l_linestatus AS team, l_partkey AS name, l_suppkey,
    row_number() OVER (
      PARTITION BY l_orderkey, l_linestatus
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem
),
firsts AS (SELECT game_id, team, name, min(rn) AS rn FROM ordered GROUP BY game_id, team, name),
slotted AS (
  SELECT game_id, team, name, CAST(row_number() OVER (PARTITION BY game_id, team ORDER BY rn) AS INT) AS slot
  FROM firsts
),
lineup AS (SELECT game_id, team, slot, name FROM slotted WHERE slot <= 3)"""

TEAMS = ENTRIES + "," + LINEUP + """,
starters AS (SELECT game_id, team, arg_max(l_suppkey, rn) AS starter FROM ordered GROUP BY game_id, team),
teams AS (
  SELECT e.game_id, e.team, e.runs, o.team AS opponent, s.starter
  FROM entries e
  JOIN entries o ON e.game_id = o.game_id AND e.team <> o.team
  LEFT JOIN starters s ON s.game_id = o.game_id AND s.team = o.team
)"""

# Batter features of every slot, pitcher features of every team, complete line-ups.
SAMPLES = TEAMS + "," + RATES + "," + PITCHERS + """,
batted AS (
  SELECT l.game_id, l.team, l.slot,
    coalesce(k.hand_code, 0)::DOUBLE AS hand, coalesce(k.avg, 0) AS avg, coalesce(k.hr, 0)::DOUBLE AS hr,
    coalesce(k.slg, 0) AS slg, coalesce(k.type_power, 0)::DOUBLE AS type_power,
    coalesce(k.type_avg, 0)::DOUBLE AS type_avg, coalesce(k.type_speed, 0)::DOUBLE AS type_speed,
    coalesce(k.type_eye, 0)::DOUBLE AS type_eye, coalesce(k.type_all, 0)::DOUBLE AS type_all
  FROM lineup l LEFT JOIN players k ON l.name = k.name
),
means AS (
  SELECT avg(hand) AS hand, avg(era) AS era, avg(k9) AS k9, avg(hr9) AS hr9,
    avg(fast_group) AS fast_group, avg(breaking_group) AS breaking_group, avg(falling_group) AS falling_group
  FROM pitchers
),
faced AS (
  SELECT t.game_id, t.team, t.runs,
    CASE WHEN p.name IS NULL THEN m.hand ELSE p.hand END::DOUBLE AS p_hand,
    coalesce(p.era, m.era) AS p_era, coalesce(p.k9, m.k9) AS p_k9, coalesce(p.hr9, m.hr9) AS p_hr9,
    coalesce(p.fast_group, m.fast_group) AS p_fast, coalesce(p.breaking_group, m.breaking_group) AS p_breaking,
    coalesce(p.falling_group, m.falling_group) AS p_falling
  FROM teams t LEFT JOIN pitchers p ON p.name = t.starter CROSS JOIN means m
),
complete AS (SELECT game_id, team FROM lineup GROUP BY game_id, team HAVING count(*) = 3),
samples AS (SELECT f.* FROM faced f JOIN complete USING (game_id, team))"""

PITCHER_VALUES = "[p_hand, p_era, p_k9, p_hr9, p_fast, p_breaking, p_falling]"


def flat_values(columns: list[str]) -> str:
    """Rows (game_id, team, pos, value) of flat vectors: batter values by slot, then the pitcher's."""
    width, total = len(columns), 3 * len(columns)
    per_slot = "[" + ", ".join(columns) + "]"
    return f"""
  SELECT b.game_id, b.team, (b.slot - 1) * {width} + i AS pos, b.v[i + 1] AS value
  FROM (SELECT batted.*, {per_slot} AS v FROM batted JOIN samples USING (game_id, team)) b, range({width}) r(i)
  UNION ALL
  SELECT s.game_id, s.team, {total} + i, s.v[i + 1]
  FROM (SELECT *, {PITCHER_VALUES} AS v FROM samples) s, range(7) r(i)"""


# The first ceil(0.2 n) samples in md5 order of their key.
SPLIT = """,
    digests AS (SELECT *, md5('42:' || game_id || ':' || team) AS d FROM samples),
    split AS (SELECT *, row_number() OVER (ORDER BY d) <= ceil(0.2::DECIMAL(10, 8) * count(*) OVER ()) AS is_valid FROM digests)"""


def gram(columns: list[str], name: str = "") -> str:
    """Tables z (standardised samples), g (correlations and covariances with the label) of a pattern's flat vectors.

    Statistics are those of the training side; a constant feature becomes zeros.
    """
    return f""",
    flat{name} AS ({flat_values(columns)}),
    vecs{name} AS (SELECT game_id, team, list(value ORDER BY pos) AS v FROM flat{name} GROUP BY ALL),
    pts{name} AS (SELECT v, runs::DOUBLE AS y, is_valid FROM vecs{name} JOIN split USING (game_id, team)),
    scale{name} AS (
      SELECT list(m ORDER BY pos) AS ms, list(CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY pos) AS ss FROM (
        SELECT pos, avg(value) AS m, stddev_pop(value) AS s FROM flat{name} JOIN split USING (game_id, team)
        WHERE NOT is_valid GROUP BY pos)),
    label{name} AS (SELECT avg(y) AS ym, var_pop(y) AS yy FROM pts{name} WHERE NOT is_valid),
    z{name} AS (
      SELECT list_transform(v, lambda x, i: (x - ms[i]) / ss[i]) AS z, y - ym AS y, is_valid FROM pts{name}, scale{name}, label{name}),
    pairs{name} AS (
      SELECT i, j, avg(z[i] * z[j]) AS c, avg(z[i] * y) AS b
      FROM (SELECT z, y, unnest(range(1, len(z) + 1)) AS i FROM z{name} WHERE NOT is_valid), range(1, (SELECT len(ms) + 1 FROM scale{name})) r(j)
      GROUP BY i, j),
    g{name} AS (
      SELECT list(row ORDER BY i) AS g, list(b ORDER BY i) AS b, any_value(yy) AS yy FROM (
        SELECT i, list(c ORDER BY j) AS row, any_value(b) AS b FROM pairs{name} GROUP BY i), label{name})"""


def sweeps(alpha: float, n: int, name: str = "") -> str:
    """Table lasso: weights after each of n sweeps of coordinate descent from zero. Needs WITH RECURSIVE."""
    rho = "(b[j[1]::INT] - list_dot_product(g[j[1]::INT], w) + g[j[1]::INT][j[1]::INT] * w[j[1]::INT])"
    shrunk = f"CASE WHEN g[j[1]::INT][j[1]::INT] > 1e-9 THEN sign({rho}) * greatest(abs({rho}) - {alpha}::DOUBLE, 0) / g[j[1]::INT][j[1]::INT] ELSE 0 END"
    sweep = f"""list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j::DOUBLE]), lambda w, j:
        list_concat(w[1:j[1]::INT - 1], [{shrunk}], w[j[1]::INT + 1:]), w)"""
    return f""",
    lasso{name}(step, w) AS (
      SELECT 0, list_transform(b, lambda x: 0.0::DOUBLE) FROM g{name}
      UNION ALL SELECT step + 1, {sweep} FROM lasso{name} CROSS JOIN g{name} WHERE step < {n})"""


def valid_mse(weights: str, name: str = "") -> str:
    """Error on the validation side of a table's one row of weights w."""
    return f"(SELECT avg((y - list_dot_product(z, w)) ** 2) FROM z{name}, {weights} WHERE is_valid)"


def conjugate(name: str = "") -> str:
    """Table ols(step, w, r, p): conjugate gradients on the normal equations, from zero, so the shortest solution comes out."""
    at = "list_transform(g, lambda row: list_dot_product(row, p))"
    a = "list_dot_product(r, r) / list_dot_product(p, q)"
    return f""",
    ols{name}(step, w, r, p) AS (
      SELECT 0, list_transform(b, lambda x: 0.0::DOUBLE), b, b FROM g{name}
      UNION ALL
      SELECT step + 1, w2, r2, list_transform(r2, lambda x, i: x + list_dot_product(r2, r2) / list_dot_product(r, r) * p[i]) FROM (
        SELECT *, list_transform(r, lambda x, i: x - a * q[i]) AS r2, list_transform(w, lambda x, i: x + a * p[i]) AS w2 FROM (
          SELECT *, {a} AS a FROM (SELECT ols{name}.*, {at} AS q FROM ols{name} CROSS JOIN g{name})
          WHERE list_dot_product(r, r) > 1e-26)))"""
