"""DuckDB SQL twins of the registered queries (the correctness oracle).

Every query reads the driver's pre-registered views (``customer events
orders lineitem part ...``) through the same adapters as ``tables.py``,
written as CTEs.  SQL is generated from the same period lists as the Spark
side so both stay in step.
"""

from __future__ import annotations

from featloom.schemas import (CLICK_METRICS, DEFAULT_LATEST, DEFAULT_PERIODS, LOAN_METRICS,
                              ORDER_METRICS, TRAILING_MAPS, TRAILING_NUMERIC, latest_name)

ADAPTERS = """
users AS (
  SELECT c_custkey AS uid, CAST(18 + c_custkey % 50 AS INTEGER) AS age,
         CAST(1 + c_custkey % 2 AS INTEGER) AS sex,
         CAST(DATE '2015-01-01' + CAST(c_custkey % 700 AS INTEGER) AS DATE) AS active_date,
         CAST(c_acctbal AS DECIMAL(18,2)) AS "limit"
  FROM customer),
clicks AS (
  SELECT user_id AS uid, ts - to_days(CAST(9100 + event_id % 700 AS INTEGER)) AS click_time,
         CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
                              WHEN 'signup' THEN 4 WHEN 'error' THEN 5 END AS BIGINT) AS pid,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS param
  FROM events),
buys AS (
  SELECT o_custkey AS uid, CAST(o_orderdate AS DATE) AS buy_date,
         CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS INTEGER) AS number,
         CAST(p_size AS BIGINT) AS cate_id,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS discount,
         o_orderkey AS order_key, l_linenumber AS line_number
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
loans AS (
  SELECT o_custkey AS uid, o_orderdate AS loan_time, CAST(o_totalprice AS DECIMAL(18,2)) AS loan_amount,
         CAST([1, 3, 6, 12][o_orderkey % 4 + 1] AS INTEGER) AS plan_num
  FROM orders),
loan_sums AS (
  SELECT uid, 11 AS month, sum(loan_amount) AS loan_sum FROM loans WHERE month(loan_time) = 11 GROUP BY uid)
"""

AMOUNT = "greatest(price * number - discount, 0)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([ADAPTERS.strip()] + [c.strip() for c in ctes]) + "\n"


def _in(periods) -> str:
    return ", ".join(str(p) for p in periods)


def _pack(key: str, value: str) -> str:
    return f"string_agg({key} || ':' || CAST({value} AS VARCHAR), ';' ORDER BY {key})"


# --- per-source per-period CTEs ------------------------------------------------

def click_cte(periods, period_fn: str = "weekofyear") -> list[str]:
    """``click_p(uid, p, n, pp, pg, pr)``: one row per (uid, period)."""
    return [
        f"""cf AS (SELECT uid, CAST({period_fn}(click_time) AS BIGINT) AS p, pid, param, count(*) AS n
            FROM clicks WHERE {period_fn}(click_time) IN ({_in(periods)}) GROUP BY ALL)""",
        f"""cnum AS (SELECT uid, p, CAST(sum(n) AS BIGINT) AS n,
            {_pack("coalesce(CAST(pid AS VARCHAR), '') || '_' || coalesce(CAST(param AS VARCHAR), '')", "n")} AS pp FROM cf GROUP BY uid, p)""",
        f"""cpg AS (SELECT uid, p, {_pack("k", "n")} AS pg FROM
            (SELECT uid, p, coalesce(CAST(pid AS VARCHAR), '') AS k, CAST(sum(n) AS BIGINT) AS n FROM cf GROUP BY uid, p, pid)
            GROUP BY uid, p)""",
        f"""cpr AS (SELECT uid, p, {_pack("k", "n")} AS pr FROM
            (SELECT uid, p, coalesce(CAST(param AS VARCHAR), '') AS k, CAST(sum(n) AS BIGINT) AS n FROM cf GROUP BY uid, p, param)
            GROUP BY uid, p)""",
        """click_p AS (SELECT cnum.uid, cnum.p, cnum.n, cnum.pp, cpg.pg, cpr.pr FROM cnum
            JOIN cpg ON cnum.uid = cpg.uid AND cnum.p = cpg.p JOIN cpr ON cnum.uid = cpr.uid AND cnum.p = cpr.p)""",
    ]


def order_cte(periods) -> list[str]:
    """``order_p(uid, p, n, amt, disc, cat)``."""
    return [
        f"""ofine AS (SELECT uid, CAST(month(buy_date) AS BIGINT) AS p, cate_id, count(*) AS n,
            sum({AMOUNT}) AS amt, sum(discount) AS disc FROM buys
            WHERE month(buy_date) IN ({_in(periods)}) GROUP BY ALL)""",
        f"""order_p AS (SELECT uid, p, CAST(sum(n) AS BIGINT) AS n, sum(amt) AS amt, sum(disc) AS disc,
            {_pack("CAST(cate_id AS VARCHAR)", "amt")} AS cat FROM ofine GROUP BY uid, p)""",
    ]


def loan_cte(periods) -> list[str]:
    """``loan_p(uid, p, n, amt, q)``."""
    return [
        f"""loan_p AS (SELECT uid, CAST(month(loan_time) AS BIGINT) AS p, count(*) AS n, sum(loan_amount) AS amt,
            sum(CAST(loan_amount / plan_num AS DECIMAL(18,6))) AS q FROM loans
            WHERE month(loan_time) IN ({_in(periods)}) GROUP BY ALL)""",
    ]


def _pick(src: str, p, expr: str, default: str) -> str:
    return f"coalesce(max(CASE WHEN {src}.p = {p} THEN {expr} END), {default})"


def click_cols(periods, src="click_p") -> list[str]:
    cols = []
    for p in periods:
        cols.append(f"{_pick(src, p, f'{src}.n', '0')} AS clickNum{p}")
    for m, f in (("clickPage", "pg"), ("clickPageParam", "pp"), ("clickParam", "pr")):
        for p in periods:
            cols.append(f"{_pick(src, p, f'{src}.{f}', chr(39) * 2)} AS {m}{p}")
    return cols


def order_cols(periods, src="order_p", native=False) -> list[str]:
    cast = (lambda e: e) if native else (lambda e: f"CAST({e} AS DOUBLE)")
    cols = [f"{_pick(src, p, f'{src}.n', '0')} AS orderNum{p}" for p in periods]
    cols += [f"{cast(_pick(src, p, f'{src}.amt', '0'))} AS orderAmount{p}" for p in periods]
    cols += [f"{cast(_pick(src, p, f'{src}.disc', '0'))} AS discountAmount{p}" for p in periods]
    cols += [f"{_pick(src, p, f'CAST({src}.disc AS DOUBLE) / {src}.n', '0.0')} AS avgDiscount{p}" for p in periods]
    return cols


def order_map_cols(periods, src="order_p") -> list[str]:
    return [f"{_pick(src, p, f'{src}.cat', chr(39) * 2)} AS amountByCateId{p}" for p in periods]


def loan_cols(periods, src="loan_p", native=False) -> list[str]:
    cast = (lambda e: e) if native else (lambda e: f"CAST({e} AS DOUBLE)")
    cols = [f"{_pick(src, p, f'{src}.n', '0')} AS loanNum{p}" for p in periods]
    cols += [f"{cast(_pick(src, p, f'{src}.amt', '0'))} AS loanAmount{p}" for p in periods]
    cols += [f"{_pick(src, p, f'CAST({src}.q AS DOUBLE) / {src}.n', '0.0')} AS avgLoanPerPlan{p}" for p in periods]
    return cols


def _wide_cte(periods=DEFAULT_PERIODS, native=True) -> list[str]:
    """``wide``: the wide row with native (decimal) sums, like the Spark side."""
    ctes = click_cte(periods, "month") + order_cte(periods) + loan_cte(periods)
    c = ", ".join(click_cols(periods))
    o = ", ".join(order_cols(periods, native=native)[:3 * len(periods)]
                  + order_cols(periods, native=native)[3 * len(periods):] + order_map_cols(periods))
    ln = ", ".join(loan_cols(periods, native=native))
    ctes += [
        f"wc AS (SELECT users.uid, {c} FROM users LEFT JOIN click_p ON users.uid = click_p.uid GROUP BY users.uid)",
        f"wo AS (SELECT users.uid, {o} FROM users LEFT JOIN order_p ON users.uid = order_p.uid GROUP BY users.uid)",
        f"wl AS (SELECT users.uid, {ln} FROM users LEFT JOIN loan_p ON users.uid = loan_p.uid GROUP BY users.uid)",
    ]
    order = []
    for m in CLICK_METRICS + ORDER_METRICS + LOAN_METRICS:
        order += [f"{m}{p}" for p in periods]
    ls = "coalesce(loan_sums.loan_sum, 0)" if native else "CAST(coalesce(loan_sums.loan_sum, 0) AS DOUBLE)"
    ctes.append(
        f"""wide AS (SELECT users.uid, users.age, users.sex, users.active_date, users."limit", {", ".join(order)},
            {ls} AS loanSum
            FROM users JOIN wc ON users.uid = wc.uid JOIN wo ON users.uid = wo.uid JOIN wl ON users.uid = wl.uid
            LEFT JOIN loan_sums ON users.uid = loan_sums.uid)""")
    return ctes


def _wide_order() -> list[str]:
    order = []
    for m in CLICK_METRICS + ORDER_METRICS + LOAN_METRICS:
        order += [f"{m}{p}" for p in DEFAULT_PERIODS]
    return order


# --- queries -------------------------------------------------------------------

def monthly_order_features(periods=DEFAULT_PERIODS) -> str:
    cols = ", ".join(order_cols(periods))
    return _with(*order_cte(periods)) + f"""
SELECT users.uid, {cols} FROM users LEFT JOIN order_p ON users.uid = order_p.uid GROUP BY users.uid"""


def order_amount_by_category(periods=DEFAULT_PERIODS) -> str:
    return _with(*order_cte(periods)) + "SELECT uid, p AS period, cat AS amountByCateId FROM order_p"


def weekly_click_features(periods=(1, 2, 3, 4)) -> str:
    cols = ", ".join(click_cols(periods))
    return _with(*click_cte(periods)) + f"""
SELECT users.uid, {cols} FROM users LEFT JOIN click_p ON users.uid = click_p.uid GROUP BY users.uid"""


def monthly_loan_features(periods=DEFAULT_PERIODS) -> str:
    cols = ", ".join(loan_cols(periods))
    return _with(*loan_cte(periods)) + f"""
SELECT users.uid, {cols} FROM users LEFT JOIN loan_p ON users.uid = loan_p.uid GROUP BY users.uid"""


def raw_feature_wide() -> str:
    cols = []
    for m in CLICK_METRICS + ORDER_METRICS + LOAN_METRICS:
        for p in DEFAULT_PERIODS:
            c = f"{m}{p}"
            cols.append(f"CAST({c} AS DOUBLE) AS {c}" if m in ("orderAmount", "discountAmount", "loanAmount") else c)
    return _with(*_wide_cte()) + f"""
SELECT uid, age, sex, CAST(active_date AS VARCHAR) AS active_date, CAST("limit" AS DOUBLE) AS "limit",
       {", ".join(cols)}, CAST(loanSum AS DOUBLE) AS loanSum FROM wide"""


def _raw_line_expr() -> str:
    parts = ["CAST(uid AS VARCHAR)", "CAST(age AS VARCHAR)", "CAST(sex AS VARCHAR)",
             "strftime(active_date, '%Y-%-m')", 'CAST("limit" AS VARCHAR)']
    parts += [f"CAST({c} AS VARCHAR)" for c in _wide_order()]
    parts.append("CAST(loanSum AS VARCHAR)")
    return " || ',' || ".join(parts)


def raw_feature_line() -> str:
    return _with(*_wide_cte()) + f"SELECT uid, {_raw_line_expr()} AS line FROM wide"


def _latest_numeric_exprs(order=DEFAULT_LATEST) -> list[str]:
    out = []
    for m in TRAILING_NUMERIC:
        acc = None
        for n, p in enumerate(order, 1):
            v = f"CAST({m}{p} AS DOUBLE)"
            acc = v if acc is None else f"({acc} + {v})"
            out.append(f"{acc} AS {latest_name(m, p, n)}")
    return out


def latest_numeric() -> str:
    return _with(*_wide_cte()) + f"SELECT uid, {', '.join(_latest_numeric_exprs())} FROM wide"


def _map_long_cte(order=DEFAULT_LATEST) -> list[str]:
    """``mlong(uid, metric, p, k, v)``: parsed map entries of the trailing periods."""
    parts = []
    for m in TRAILING_MAPS:
        for p in order:
            parts.append(f"SELECT uid, '{m}' AS metric, {p} AS p, unnest(string_split({m}{p}, ';')) AS e FROM wide")
    return [
        "ment AS (" + " UNION ALL ".join(parts) + ")",
        """mparts AS (SELECT uid, metric, p, string_split(regexp_replace(e, ':+$', ''), ':') AS kv FROM ment)""",
        """mlong AS (SELECT uid, metric, p, kv[1] AS k, CAST(kv[2] AS DOUBLE) AS v FROM mparts WHERE len(kv) = 2)""",
    ]


def _latest_map_cte(order=DEFAULT_LATEST) -> list[str]:
    p1, p2, p3 = order
    return _map_long_cte(order) + [
        f"""mk AS (SELECT uid, metric, k,
              coalesce(max(CASE WHEN p = {p1} THEN v END), 0.0) AS v1,
              coalesce(max(CASE WHEN p = {p2} THEN v END), 0.0) AS v2,
              coalesce(max(CASE WHEN p = {p3} THEN v END), 0.0) AS v3,
              bool_or(p IN ({p1}, {p2})) AS in2
            FROM mlong GROUP BY uid, metric, k)""",
        """mpack AS (SELECT uid, metric,
              string_agg(CASE WHEN in2 THEN k || ':' || CAST(v1 + v2 AS VARCHAR) END, ';' ORDER BY k) AS l2,
              string_agg(k || ':' || CAST((v1 + v2) + v3 AS VARCHAR), ';' ORDER BY k) AS l3
            FROM mk GROUP BY uid, metric)""",
    ]


def _latest_map_cols(order=DEFAULT_LATEST) -> list[str]:
    p1, p2, p3 = order
    cols = []
    for m in TRAILING_MAPS:
        cols.append(f"wide.{m}{p1} AS {latest_name(m, p1, 1)}")
        cols.append(f"coalesce(max(CASE WHEN mpack.metric = '{m}' THEN mpack.l2 END), '') AS {latest_name(m, p2, 2)}")
        cols.append(f"coalesce(max(CASE WHEN mpack.metric = '{m}' THEN mpack.l3 END), '') AS {latest_name(m, p3, 3)}")
    return cols


def latest_map() -> str:
    return _with(*_wide_cte(), *_latest_map_cte()) + f"""
SELECT wide.uid, {', '.join(_latest_map_cols())}
FROM wide LEFT JOIN mpack ON wide.uid = mpack.uid GROUP BY ALL"""


def latest_numeric_long(order=DEFAULT_LATEST) -> str:
    r1, r2, r3 = order
    return _with(*order_cte(DEFAULT_PERIODS), f"""rk AS (SELECT uid, p, CASE p WHEN {r1} THEN 1 WHEN {r2} THEN 2
            WHEN {r3} THEN 3 END AS r, CAST(n AS DOUBLE) AS v FROM order_p WHERE p IN ({r1}, {r2}, {r3}))""") + """
SELECT uid, CAST(p AS BIGINT) AS period, CAST(r AS INTEGER) AS n,
       sum(v) OVER (PARTITION BY uid ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS orders_latest
FROM rk"""


def latest_map_long(order=DEFAULT_LATEST) -> str:
    r1, r2, r3 = order
    return _with(*order_cte(DEFAULT_PERIODS), f"""lm AS (SELECT uid, CASE p WHEN {r1} THEN 1 WHEN {r2} THEN 2 WHEN {r3} THEN 3 END AS r, cat
            FROM order_p WHERE p IN ({r1}, {r2}, {r3}))""",
        """le AS (SELECT uid, r, kv[1] AS k, CAST(kv[2] AS DOUBLE) AS v FROM (
            SELECT uid, r, string_split(regexp_replace(e, ':+$', ''), ':') AS kv
            FROM (SELECT uid, r, unnest(string_split(cat, ';')) AS e FROM lm)) WHERE len(kv) = 2)""",
        """lk AS (SELECT uid, k, max(CASE WHEN r = 1 THEN v END) AS v1, max(CASE WHEN r = 2 THEN v END) AS v2,
            max(CASE WHEN r = 3 THEN v END) AS v3 FROM le GROUP BY uid, k)""",
        """ls AS (SELECT uid, k, 1 AS n, CASE WHEN v1 IS NOT NULL THEN coalesce(v1, 0.0) END AS s FROM lk
            UNION ALL SELECT uid, k, 2, CASE WHEN v1 IS NOT NULL OR v2 IS NOT NULL
                THEN coalesce(v1, 0.0) + coalesce(v2, 0.0) END FROM lk
            UNION ALL SELECT uid, k, 3, CASE WHEN v1 IS NOT NULL OR v2 IS NOT NULL OR v3 IS NOT NULL
                THEN (coalesce(v1, 0.0) + coalesce(v2, 0.0)) + coalesce(v3, 0.0) END FROM lk)""",
        """lp AS (SELECT uid, n, string_agg(k || ':' || CAST(s AS VARCHAR), ';' ORDER BY k) AS latest
            FROM ls WHERE s IS NOT NULL GROUP BY uid, n)""",
        """lf AS (SELECT uid, min(r) AS f FROM lm GROUP BY uid)""",
        """lnn AS (SELECT uid, n FROM lf, (VALUES (1), (2), (3)) AS t(n) WHERE n >= f)""",
    ) + """
SELECT lnn.uid, lnn.n, coalesce(lp.latest, '') AS latest FROM lnn LEFT JOIN lp ON lnn.uid = lp.uid AND lnn.n = lp.n"""


def trailing_feature_line() -> str:
    num = _latest_numeric_exprs()
    num_names = [e.rsplit(" AS ", 1)[1] for e in num]
    maps = _latest_map_cols()
    map_names = [e.rsplit(" AS ", 1)[1] for e in maps]
    tail = " || ',' || ".join([f"CAST({n} AS VARCHAR)" for n in num_names] + map_names)
    return _with(*_wide_cte(), *_latest_map_cte()) + f"""
, lat AS (SELECT wide.uid, {', '.join(num)}, {', '.join(maps)}
          FROM wide LEFT JOIN mpack ON wide.uid = mpack.uid GROUP BY ALL)
SELECT uid, {_raw_line_expr()} || ',' || {tail} AS line FROM wide JOIN lat USING (uid)"""


def _java_hash(value_sql: str, prefix: str) -> str:
    """abs(Java String.hashCode(prefix || value)) % 1000, folded over characters."""
    from featloom.functions.hashing import java_string_hash
    start = java_string_hash(prefix) % (1 << 32)
    h = (f"list_reduce(list_transform(list_filter(string_split(CAST({value_sql} AS VARCHAR), ''), lambda ch: ch <> ''), "
         f"lambda ch: CAST(ascii(ch) AS BIGINT)), "
         f"lambda a, x: (a * 31 + x) % 4294967296, CAST({start} AS BIGINT))")
    return f"(abs(({h} + 2147483648) % 4294967296 - 2147483648) % 1000)"


def _sha1_bucket(text_sql: str) -> str:
    return (f"list_reduce(list_transform(string_split(sha1({text_sql}), ''), "
            f"lambda ch: CAST(strpos('0123456789abcdef', ch) - 1 AS BIGINT)), "
            f"lambda a, x: (a * 16 + x) % 1000, CAST(0 AS BIGINT))")


def _month_sample(period: int, slot: int, label_sql: str | None) -> str:
    from featloom.functions.hashing import java_hash_bucket
    dbl = lambda c: f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)"
    feats = [f"CAST({_java_hash('age', 'age')} AS VARCHAR) || ':1'",
             f"CAST({_java_hash('sex', 'sex')} AS VARCHAR) || ':1'",
             f"'{java_hash_bucket('limit')}:' || {dbl(chr(34) + 'limit' + chr(34))}"]
    for m in ("clickNum", "orderNum", "orderAmount", "loanNum", "loanAmount"):
        feats.append(f"'{java_hash_bucket(f'{m}_{slot}')}:' || {dbl(f'{m}{period}')}")
    label = "'0'" if label_sql is None else dbl(label_sql)
    return _with(*_wide_cte()) + f"SELECT uid, {label} || ' ' || " + " || ' ' || ".join(feats) + " AS line FROM wide"


def sample_by_month() -> str:
    return _month_sample(8, 1, "loanAmount9")


def sample_nov() -> str:
    return _month_sample(9, 2, "loanSum")


def sample_dec() -> str:
    return _month_sample(10, 3, None)


def sample_fanout(periods=DEFAULT_PERIODS) -> str:
    from featloom.functions.hashing import sha1_bucket
    rows = []
    for k, p in enumerate(periods[:-1]):
        nxt = periods[k + 1]
        feats = [f"CAST({_sha1_bucket(chr(39) + 'age' + chr(9) + chr(39) + ' || CAST(age AS VARCHAR)')} AS VARCHAR) || ':1'",
                 f"CAST({_sha1_bucket(chr(39) + 'sex' + chr(9) + chr(39) + ' || CAST(sex AS VARCHAR)')} AS VARCHAR) || ':1'",
                 f"'{sha1_bucket('limit')}:' || CAST(\"limit\" AS VARCHAR)"]
        for slot, c in (("click_num", f"clickNum{p}"), ("order_num", f"orderNum{p}"),
                        ("order_sum", f"orderAmount{p}"), ("loan_num", f"loanNum{p}"),
                        ("loan_sum", f"loanAmount{p}")):
            feats.append(f"'{sha1_bucket(slot)}:' || CAST({c} AS VARCHAR)")
        line = f"CAST(loanAmount{nxt} AS VARCHAR) || ' ' || " + " || ' ' || ".join(feats)
        rows.append(f"SELECT uid, {p} AS period, {line} AS line FROM wide")
    return _with(*_wide_cte()) + " UNION ALL ".join(rows)


# Encoder input: one row per user (row order = uid).
ENCODER_ROWS = """
enc_pages AS (SELECT uid, string_agg(CAST(pid AS VARCHAR) || ':' || CAST(n AS VARCHAR), ';' ORDER BY CAST(pid AS VARCHAR)) AS page_m
              FROM (SELECT uid, pid, count(*) AS n FROM clicks GROUP BY uid, pid) GROUP BY uid),
enc_orders AS (SELECT uid, count(*) AS n FROM buys GROUP BY uid),
enc_rows AS (SELECT users.uid, users.age AS age_d, users.sex AS sex_d, coalesce(enc_pages.page_m, '') AS page_m,
             coalesce(enc_orders.n, 0) AS n_orders, coalesce(loan_sums.loan_sum, 0) AS loan_sum
             FROM users LEFT JOIN enc_pages ON users.uid = enc_pages.uid
             LEFT JOIN enc_orders ON users.uid = enc_orders.uid LEFT JOIN loan_sums ON users.uid = loan_sums.uid),
enc_valid AS (SELECT *, list_filter(string_split(page_m, ';'), lambda e: len(string_split(e, ':')) = 2) AS ents FROM enc_rows),
enc_feats AS (
  SELECT uid, 0 AS pos, 'uid' AS key, CAST(uid AS VARCHAR) AS value FROM enc_valid
  UNION ALL SELECT uid, 1, 'age_d_' || CAST(age_d AS VARCHAR), '1' FROM enc_valid
  UNION ALL SELECT uid, 2, 'sex_d_' || CAST(sex_d AS VARCHAR), '1' FROM enc_valid
  UNION ALL SELECT uid, 2 + i, 'page_m_' || string_split(ents[i], ':')[1], string_split(ents[i], ':')[2]
            FROM (SELECT uid, ents, generate_subscripts(ents, 1) AS i FROM enc_valid)
  UNION ALL SELECT uid, 3 + len(ents), 'n_orders', CAST(n_orders AS VARCHAR) FROM enc_valid),
enc_dict AS (SELECT key, row_number() OVER (ORDER BY r, p, key) AS id
             FROM (SELECT key, min(uid) AS r, arg_min(pos, uid) AS p FROM enc_feats GROUP BY key))
"""


def encode_dictionary() -> str:
    return _with(ENCODER_ROWS) + "SELECT key, CAST(id AS BIGINT) AS id FROM enc_dict"


def encode_lines() -> str:
    return _with(ENCODER_ROWS) + """
SELECT r.uid, CAST(r.loan_sum AS VARCHAR) || ' ' || coalesce(f.feats, '') || '#' || CAST(r.uid AS VARCHAR) || chr(9)
       || CAST(r.sex_d AS VARCHAR) AS line
FROM enc_rows r LEFT JOIN (
  SELECT enc_feats.uid, string_agg(CAST(enc_dict.id AS VARCHAR) || ':' || enc_feats.value, ' ' ORDER BY enc_feats.pos) AS feats
  FROM enc_feats JOIN enc_dict ON enc_feats.key = enc_dict.key GROUP BY enc_feats.uid) f ON r.uid = f.uid"""


def csv_parse_orders() -> str:
    return _with() + f"""
SELECT uid, buy_date, CAST(CASE WHEN (order_key + line_number) % 10 = 0 THEN -1 ELSE price END AS DOUBLE) AS price,
       number, cate_id, CAST(discount AS DOUBLE) AS discount,
       CAST(greatest(CASE WHEN (order_key + line_number) % 10 = 0 THEN -1 ELSE price END * number - discount, 0) AS DOUBLE) AS amount
FROM buys"""


def user_snapshot(months) -> str:
    ms = ", ".join(f"({m})" for m in months)
    return _with(
        f"snap_months AS (SELECT * FROM (VALUES {ms}) AS t(m))",
        "cm AS (SELECT uid, month(click_time) AS mm, count(*) AS n FROM clicks GROUP BY ALL)",
        f"om AS (SELECT uid, month(buy_date) AS mm, count(*) AS n, sum({AMOUNT}) AS a FROM buys GROUP BY ALL)",
        "lm AS (SELECT uid, month(loan_time) AS mm, count(*) AS n, sum(loan_amount) AS a FROM loans GROUP BY ALL)",
        """us AS (SELECT users.uid, snap_months.m FROM users CROSS JOIN snap_months)""",
        """sc AS (SELECT us.uid, us.m, coalesce(sum(cm.n), 0) AS n FROM us LEFT JOIN cm ON us.uid = cm.uid AND cm.mm < us.m GROUP BY ALL)""",
        """so AS (SELECT us.uid, us.m, coalesce(sum(om.n), 0) AS n, coalesce(sum(om.a), 0) AS a FROM us LEFT JOIN om ON us.uid = om.uid AND om.mm < us.m GROUP BY ALL)""",
        """sl AS (SELECT us.uid, us.m, coalesce(sum(lm.n), 0) AS n, coalesce(sum(lm.a), 0) AS a FROM us LEFT JOIN lm ON us.uid = lm.uid AND lm.mm < us.m GROUP BY ALL)""",
        """sls AS (SELECT us.uid, us.m, coalesce(sum(lm.a), 0) AS a FROM us LEFT JOIN lm ON us.uid = lm.uid AND lm.mm = us.m GROUP BY ALL)""",
    ) + """
SELECT CAST(sc.uid AS VARCHAR) || '_' || CAST(sc.m AS VARCHAR) || '_0' AS id, sc.uid, CAST(sc.m AS INTEGER) AS snapshot_month,
       CAST(sc.n AS BIGINT) AS n_clicks, CAST(so.n AS BIGINT) AS n_orders, CAST(so.a AS DOUBLE) AS order_amount,
       CAST(sl.n AS BIGINT) AS n_loans, CAST(sl.a AS DOUBLE) AS loan_amount, CAST(sls.a AS DOUBLE) AS loan_sum
FROM sc JOIN so ON sc.uid = so.uid AND sc.m = so.m JOIN sl ON sc.uid = sl.uid AND sc.m = sl.m
JOIN sls ON sc.uid = sls.uid AND sc.m = sls.m"""


def snapshot_order_records(months=(9, 10, 11)) -> str:
    ms = ", ".join(f"({m})" for m in months)
    return _with(f"snap_months AS (SELECT * FROM (VALUES {ms}) AS t(m))") + """
SELECT CAST(uid AS VARCHAR) || '_' || CAST(m AS VARCHAR) || '_0' AS id, uid, CAST(m AS INTEGER) AS snapshot_month,
       buy_date, CAST(price AS DOUBLE) AS price, number, cate_id, CAST(discount AS DOUBLE) AS discount
FROM buys JOIN snap_months ON month(buy_date) < m"""


def assembled_users() -> str:
    return _with(
        "ac AS (SELECT uid, count(*) AS n FROM clicks GROUP BY uid)",
        f"ao AS (SELECT uid, count(*) AS n, sum({AMOUNT}) AS a FROM buys GROUP BY uid)",
        "al AS (SELECT uid, count(*) AS n, sum(loan_amount) AS a FROM loans GROUP BY uid)",
    ) + """
SELECT users.uid, coalesce(ac.n, 0) AS n_clicks, coalesce(ao.n, 0) AS n_orders, CAST(coalesce(ao.a, 0) AS DOUBLE) AS order_amount,
       coalesce(al.n, 0) AS n_loans, CAST(coalesce(al.a, 0) AS DOUBLE) AS loan_amount,
       CAST(coalesce(loan_sums.loan_sum, 0) AS DOUBLE) AS loan_sum
FROM users LEFT JOIN ac ON users.uid = ac.uid LEFT JOIN ao ON users.uid = ao.uid LEFT JOIN al ON users.uid = al.uid
LEFT JOIN loan_sums ON users.uid = loan_sums.uid"""


def cutoff_filtered_users(cutoff: str = "1998-11-01 00:00:00") -> str:
    return _with(
        f"fc AS (SELECT uid, count(*) AS n FROM clicks WHERE click_time < TIMESTAMP '{cutoff}' GROUP BY uid)",
        f"fo AS (SELECT uid, count(*) AS n FROM buys WHERE CAST(buy_date AS TIMESTAMP) < TIMESTAMP '{cutoff}' GROUP BY uid)",
        f"fl AS (SELECT uid, count(*) AS n FROM loans WHERE loan_time < TIMESTAMP '{cutoff}' GROUP BY uid)",
    ) + """
SELECT users.uid, coalesce(fc.n, 0) AS n_clicks, coalesce(fo.n, 0) AS n_orders, coalesce(fl.n, 0) AS n_loans
FROM users LEFT JOIN fc ON users.uid = fc.uid LEFT JOIN fo ON users.uid = fo.uid LEFT JOIN fl ON users.uid = fl.uid"""


def loan_label_month(month: int = 11) -> str:
    return _with(f"ll AS (SELECT uid, sum(loan_amount) AS s FROM loans WHERE month(loan_time) = {month} GROUP BY uid)") + """
SELECT users.uid, CAST(coalesce(ll.s, 0) AS DOUBLE) AS loan_sum FROM users LEFT JOIN ll ON users.uid = ll.uid"""


def attach_column() -> str:
    return _with() + """
SELECT users.uid, users.age, CAST(loan_sums.loan_sum AS DOUBLE) AS loan_sum FROM users JOIN loan_sums ON users.uid = loan_sums.uid"""


def merge_map_columns() -> str:
    return _with(*click_cte((1, 2, 3, 4))) + """
, mm AS (SELECT a.uid, k, CAST(v AS DOUBLE) AS v FROM (
    SELECT uid, unnest(string_split(pg, ';')) AS e FROM click_p WHERE p IN (1, 2)) a,
    LATERAL (SELECT string_split(e, ':')[1] AS k, string_split(e, ':')[2] AS v))
, both_users AS (SELECT uid FROM click_p GROUP BY uid HAVING bool_or(p = 1) AND bool_or(p = 2))
SELECT both_users.uid, string_agg(mm.k || ':' || CAST(mm.s AS VARCHAR), ';' ORDER BY mm.k) AS merged
FROM both_users JOIN (SELECT uid, k, sum(v) AS s FROM mm GROUP BY uid, k) mm ON both_users.uid = mm.uid
GROUP BY both_users.uid"""


def combine_sum() -> str:
    return _with(
        f"ca AS (SELECT uid, sum({AMOUNT}) AS v FROM buys GROUP BY uid)",
        "cb AS (SELECT uid, sum(loan_amount) AS v FROM loans GROUP BY uid)",
    ) + """
SELECT uid, CAST(sum(v) AS DOUBLE) AS total
FROM (SELECT uid, CAST(v AS DECIMAL(38,4)) AS v FROM ca UNION ALL SELECT uid, CAST(v AS DECIMAL(38,4)) FROM cb) GROUP BY uid"""


def csv_rejects(n_fields: int = 3) -> str:
    return f"""
SELECT conv_id, turn, CAST(length(text) - length(replace(text, ',', '')) + 1 AS BIGINT) AS n_fields
FROM conversations WHERE length(text) - length(replace(text, ',', '')) + 1 <> {n_fields}"""


def split_train_validation() -> str:
    b = _sha1_bucket("CAST(uid AS VARCHAR)")
    return _with() + f"SELECT uid, {b} AS bucket, {b} < 900 AS is_train FROM users"


def rmse_zero_baseline() -> str:
    b = _sha1_bucket("CAST(users.uid AS VARCHAR)")
    return _with(
        "ll AS (SELECT uid, sum(loan_amount) AS s FROM loans WHERE month(loan_time) = 11 GROUP BY uid)",
        f"val AS (SELECT users.uid, coalesce(ll.s, 0) AS label FROM users LEFT JOIN ll ON users.uid = ll.uid WHERE {b} >= 900)",
    ) + """
SELECT count(*) AS n, CASE WHEN count(*) > 0 THEN sqrt(CAST(sum((0 - label) * (0 - label)) AS DOUBLE) / count(*)) END AS rmse FROM val"""


def linreg_single_feature() -> str:
    return _with(f"xy AS (SELECT CAST(number AS DOUBLE) AS x, CAST({AMOUNT} AS DOUBLE) AS y FROM buys)") + """
SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM xy"""


def snapshot_click_records(months=(9, 10, 11)) -> str:
    ms = ", ".join(f"({m})" for m in months)
    return _with(f"snap_months AS (SELECT * FROM (VALUES {ms}) AS t(m))") + """
SELECT CAST(uid AS VARCHAR) || '_' || CAST(m AS VARCHAR) || '_0' AS id, uid, CAST(m AS INTEGER) AS snapshot_month,
       strftime(click_time, '%Y-%m-%d %H:%M:%S') AS click_time, pid, param
FROM clicks JOIN snap_months ON month(click_time) < m"""


def snapshot_loan_records(months=(9, 10, 11)) -> str:
    ms = ", ".join(f"({m})" for m in months)
    return _with(f"snap_months AS (SELECT * FROM (VALUES {ms}) AS t(m))") + """
SELECT CAST(uid AS VARCHAR) || '_' || CAST(m AS VARCHAR) || '_0' AS id, uid, CAST(m AS INTEGER) AS snapshot_month,
       strftime(loan_time, '%Y-%m-%d %H:%M:%S') AS loan_time, CAST(loan_amount AS DOUBLE) AS loan_amount, plan_num
FROM loans JOIN snap_months ON month(loan_time) < m"""


def csv_parse_users() -> str:
    return _with() + 'SELECT uid, age, sex, active_date, CAST("limit" AS DOUBLE) AS "limit" FROM users'


def csv_parse_clicks() -> str:
    return _with() + "SELECT uid, strftime(click_time, '%Y-%m-%d %H:%M:%S') AS click_time, pid, param FROM clicks"


def csv_parse_loans() -> str:
    return _with() + """
SELECT uid, strftime(loan_time, '%Y-%m-%d %H:%M:%S') AS loan_time, CAST(loan_amount AS DOUBLE) AS loan_amount, plan_num
FROM loans"""


def csv_parse_loan_sums() -> str:
    return _with() + "SELECT uid, CAST(loan_sum AS DOUBLE) AS loan_sum FROM loan_sums"


def delimited_users() -> str:
    return _with() + """
SELECT uid, age, sex, active_date, CAST(CASE WHEN uid % 7 = 0 THEN -1 ELSE "limit" END AS DOUBLE) AS "limit"
FROM users WHERE uid % 11 <> 0"""


def encode_with_existing() -> str:
    return _with(ENCODER_ROWS,
                 "known AS (SELECT 'page_m_' || CAST(pid AS VARCHAR) AS key, max(pid) * 10 AS id FROM clicks WHERE pid IS NOT NULL GROUP BY pid)",
                 """fresh AS (SELECT key, row_number() OVER (ORDER BY id) AS k FROM enc_dict
                    WHERE key NOT IN (SELECT key FROM known))""") + """
SELECT key, CAST(id AS BIGINT) AS id FROM known
UNION ALL SELECT key, CAST(k + (SELECT coalesce(max(id), 0) FROM known) AS BIGINT) FROM fresh"""


# --- least squares from sums -----------------------------------------------------

LINEAR_FEATURES = ("age", '"limit"', "sex", "year(active_date) - 1900", "month(active_date) - 1", "day(active_date)")


def _plus(terms) -> str:
    out = terms[0]
    for x in terms[1:]:
        out = f"({out} + {x})"
    return out


def _gradient_ctes(steps: int = 100, step_size: float = 1e-8, tolerance: float = 1e-3) -> list[str]:
    """``fit(grp, t, w0.., done)``: the steps on the sums in ``m(grp, n, x{i}_{j}, xy{i}, yy)``, in the order Spark takes them."""
    d = range(len(LINEAR_FEATURES))
    at = lambda i, j: f"m.x{min(i, j)}_{max(i, j)}"
    moved = [f"fit.w{i} - {step_size!r}::DOUBLE / sqrt((t + 1)::DOUBLE) * (({_plus([f'{at(i, j)} * fit.w{j}' for j in d])} - m.xy{i}) / n::DOUBLE) AS v{i}" for i in d]
    gap = f"sqrt({_plus([f'(v{i} - w{i}) * (v{i} - w{i})' for i in d])})"
    norm = f"sqrt({_plus([f'v{i} * v{i}' for i in d])})"
    return [f"""fit AS (SELECT grp, 0 AS t, {", ".join(f"0::DOUBLE AS w{i}" for i in d)}, n = 0 AS done FROM m
  UNION ALL SELECT grp, t + 1, {", ".join(f"v{i}" for i in d)}, t + 1 > 1 AND {gap} < {tolerance!r}::DOUBLE * greatest({norm}, 1::DOUBLE)
  FROM (SELECT fit.*, n, {", ".join(moved)} FROM fit JOIN m USING (grp) WHERE NOT done AND t < {steps}))""",
            "fitted AS (SELECT * FROM fit QUALIFY t = max(t) OVER (PARTITION BY grp))"]


def _sums(prefix: str = "") -> list[str]:
    d = range(len(LINEAR_FEATURES))
    return [*[f"x{i}_{j}" for i in d for j in d if i <= j], *[f"xy{i}" for i in d], "yy"]


def _linear_rows() -> list[str]:
    feats = ", ".join(f"CAST({f} AS DECIMAL(18,2)) AS f{i}" for i, f in enumerate(LINEAR_FEATURES))
    d = range(len(LINEAR_FEATURES))
    sums = [f"sum(f{i} * f{j}) AS x{i}_{j}" for i in d for j in d if i <= j] + [f"sum(f{i} * label) AS xy{i}" for i in d] + ["sum(label * label) AS yy"]
    return [
        "ll AS (SELECT uid, sum(loan_amount) AS s FROM loans WHERE month(loan_time) = 11 GROUP BY uid)",
        f"""rows AS (SELECT {_sha1_bucket("CAST(users.uid AS VARCHAR)")} AS bucket, {feats}, CAST(coalesce(ll.s, 0) AS DECIMAL(18,2)) AS label
            FROM users LEFT JOIN ll ON users.uid = ll.uid)""",
        f"folds AS (SELECT bucket // 100 AS fold, count(*) AS n, {', '.join(sums)} FROM rows GROUP BY ALL)",
        f"train AS (SELECT count(*) AS n, {', '.join(sums)} FROM rows WHERE bucket < 900)",
    ]


def _error(alias: str) -> str:
    d = range(len(LINEAR_FEATURES))
    at = lambda i, j: f"{alias}.x{min(i, j)}_{max(i, j)}::DOUBLE"
    fit = _plus([f"w{i} * {alias}.xy{i}::DOUBLE" for i in d])
    square = _plus([f"w{i} * ({_plus([f'{at(i, j)} * w{j}' for j in d])})" for i in d])
    return f"sqrt(greatest({alias}.yy::DOUBLE - 2::DOUBLE * {fit} + {square}, 0::DOUBLE) / {alias}.n)"


def linreg_sgd_steps() -> str:
    names = ("f_age", "f_limit", "f_sex", "f_year", "f_month", "f_day")
    m = f"m AS (SELECT 0 AS grp, n, {', '.join(f'{c}::DOUBLE AS {c}' for c in _sums())} FROM train)"
    return _with(*_linear_rows(), m, *_gradient_ctes()).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT m.n, t AS steps, {", ".join(f"w{i} AS w_{c}" for i, c in enumerate(names))}, sqrt(yy / m.n) AS rmse_zero, {_error("m")} AS rmse_model
FROM m JOIN fitted USING (grp)"""


def kfold_sgd_rmse() -> str:
    rest = ", ".join(f"(sum({c}) OVER () - {c})::DOUBLE AS {c}" for c in _sums())
    m = f"m AS (SELECT fold AS grp, sum(n) OVER () - n AS n, {rest} FROM folds)"
    return _with(*_linear_rows(), m, *_gradient_ctes()).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT fold, CAST(m.n AS BIGINT) AS n_train, folds.n AS n_valid, t AS steps, sqrt(folds.yy::DOUBLE / folds.n) AS rmse_zero, {_error("folds")} AS rmse_model
FROM folds JOIN m ON m.grp = fold JOIN fitted ON fitted.grp = fold"""


# --- nested users ------------------------------------------------------------------

_RECORDS = {
    "clicks": ("clicks", "click_time", "click_time, pid, param",
               "strftime(click_time, '%Y-%m-%d %H:%M:%S') || ':' || coalesce(pid::VARCHAR, '') || ':' || coalesce(param::VARCHAR, '')"),
    "orders": ("buys", "buy_date", "buy_date, price, number, cate_id, discount, order_key, line_number",
               "buy_date::VARCHAR || ':' || order_key::VARCHAR || ':' || line_number::VARCHAR || ':' || number::VARCHAR"),
    "loans": ("loans", "loan_time", "loan_time, loan_amount, plan_num",
              "strftime(loan_time, '%Y-%m-%d %H:%M:%S') || ':' || loan_amount::VARCHAR || ':' || plan_num::VARCHAR"),
}


def _chunk_ctes(size: int, before_month: int | None = None) -> list[str]:
    """``placed(uid, kind, pos, chunk_no, ts, txt)`` and ``chunk_keys(uid, chunk_no)`` (every user has chunk 0)."""
    parts = []
    for kind, (table, ts, order, txt) in _RECORDS.items():
        month = f" WHERE month({ts}) < {before_month}" if before_month else ""
        parts.append(f"""SELECT uid, '{kind}' AS kind, row_number() OVER (PARTITION BY uid ORDER BY {", ".join(f"{c} NULLS FIRST" for c in order.split(", "))}) - 1 AS pos,
          CAST({ts} AS TIMESTAMP) AS ts, {txt} AS txt FROM (SELECT * FROM {table}{month}) WHERE uid IN (SELECT uid FROM users)""")
    return [f"placed AS (SELECT *, pos // {size} AS chunk_no FROM ({' UNION ALL '.join(parts)}))",
            "chunk_keys AS (SELECT uid, 0 AS chunk_no FROM users UNION SELECT uid, chunk_no FROM placed)"]


def _per_kind(form: str) -> str:
    return ", ".join(form.format(k=k, on=f"kind = '{k}'") for k in _RECORDS)


def nested_user_chunks(size: int) -> str:
    return _with(*_chunk_ctes(size)) + f"""
SELECT k.uid, users.age, k.chunk_no, {_per_kind("coalesce(string_agg(txt, ';' ORDER BY pos) FILTER ({on}), '') AS {k}")},
  CAST(coalesce(any_value(loan_sums.loan_sum), 0) AS DOUBLE) AS loan_sum
FROM chunk_keys k JOIN users ON users.uid = k.uid LEFT JOIN loan_sums ON loan_sums.uid = k.uid LEFT JOIN placed p ON p.uid = k.uid AND p.chunk_no = k.chunk_no
GROUP BY k.uid, users.age, k.chunk_no"""


def nested_snapshot_chunks(size: int, before_month: int = 10) -> str:
    return _with(*_chunk_ctes(size, before_month)) + f"""
SELECT k.uid, k.chunk_no, {_per_kind("count(*) FILTER ({on}) AS n_{k}")},
  {_per_kind("strftime(min(ts) FILTER ({on}), '%Y-%m-%d %H:%M:%S') AS {k}_from, strftime(max(ts) FILTER ({on}), '%Y-%m-%d %H:%M:%S') AS {k}_to")}
FROM chunk_keys k LEFT JOIN placed p ON p.uid = k.uid AND p.chunk_no = k.chunk_no GROUP BY k.uid, k.chunk_no"""


def nested_cutoff_chunks(size: int, cutoff: str) -> str:
    return _with(*_chunk_ctes(size)) + f"""
SELECT k.uid, k.chunk_no, {_per_kind("count(*) FILTER ({on}) AS n_{k}")}, {_per_kind("strftime(max(ts) FILTER ({on}), '%Y-%m-%d %H:%M:%S') AS {k}_to")}
FROM chunk_keys k LEFT JOIN (SELECT * FROM placed WHERE ts < TIMESTAMP '{cutoff}') p ON p.uid = k.uid AND p.chunk_no = k.chunk_no
GROUP BY k.uid, k.chunk_no HAVING k.chunk_no = 0 OR count(kind) > 0"""


def attach_by_position() -> str:
    return _with(
        "a AS (SELECT row_number() OVER (ORDER BY uid) - 1 AS pos, uid, age FROM users)",
        "b AS (SELECT row_number() OVER (ORDER BY loan_time, uid, loan_amount, plan_num) - 1 AS pos, uid AS loan_uid, loan_amount FROM loans)",
    ) + "SELECT a.pos, a.uid, a.age, b.loan_uid, CAST(b.loan_amount AS DOUBLE) AS loan_amount FROM a JOIN b ON a.pos = b.pos"
