"""DuckDB twins of the experiment queries."""

from __future__ import annotations

from meridia.operators import integrity as ig

_LONG = """
long AS (SELECT l_returnflag AS cell, l_partkey AS example_id, l_linenumber AS trial, l_extendedprice AS price, l_orderkey * 10 + l_linenumber AS k FROM lineitem),
valid AS (SELECT * FROM long WHERE k % 17 <> 0 AND k % 23 <> 0),
headline AS (SELECT * FROM valid WHERE k % 11 <> 0),
per_example AS (SELECT cell, example_id, avg(price) AS value, count(*) AS n_rows FROM headline GROUP BY ALL)
"""
_PAIRS = f"""
{_LONG},
pairs AS (
  SELECT *, a - b AS delta FROM (SELECT example_id, max(value) FILTER (cell = 'A') AS a, max(value) FILTER (cell = 'N') AS b FROM per_example WHERE cell IN ('A', 'N') GROUP BY example_id)
),
contrasts AS (SELECT example_id % 4 AS contrast, example_id, round(a / 1000) AS a, round(b / 1000) AS b FROM pairs WHERE delta IS NOT NULL)
"""
_REQUESTS = """
requests AS (
  SELECT *, ok AND ttft_s <= 10 * 0.1::DOUBLE AND tpot_s <= 5 * 0.02::DOUBLE AS timely FROM (
    SELECT hour(ts) AS window_id, event_type, event_id % 19 <> 0 AS ok, value / 100 AS ttft_s, value / 2000 AS tpot_s, event_id % 19 <> 0 AND event_id % 7 <> 0 AS veridical,
      CAST(minute(ts) * 60 + second(ts) AS DOUBLE) AS arrival_s, event_id, user_id, value FROM events
  )
)
"""
_FAMILIES = "families AS (SELECT o_custkey % 50 AS family, o_orderkey AS seq, ((o_orderkey * 7919) % 10007) / 100070.0::DOUBLE AS p FROM orders)"
_SCORED = "scored AS (SELECT doc_id, quality, toxic, n_chars, floor(ln(n_chars + 1.0::DOUBLE) * 4) / 4 AS score FROM labels JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))"
_AUC = "(sum(r) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * (count(*) - sum(quality)))"
_ZOH = """
samples AS (SELECT event_type, epoch_us(ts) / 1e6 AS ts_s, (value % 100) / 100 AS kv, event_id FROM events),
held AS (
  SELECT *, floor(ts_s / 7200) * 7200 AS t_start, event_id < lag(event_id) OVER w AS fell, coalesce(lead(ts_s) OVER w, floor(ts_s / 7200) * 7200 + 7200) - ts_s AS hold
  FROM samples WINDOW w AS (PARTITION BY event_type, floor(ts_s / 7200) ORDER BY ts_s, kv, event_id)
),
windows AS (
  SELECT event_type, t_start, count(*) AS n_samples, sum(hold) / 7200 AS coverage, coalesce(bool_or(fell), false) AS fell, sum(hold * kv) / sum(hold) AS mean, max_by(event_id, ts_s) - min_by(event_id, ts_s) AS events
  FROM held GROUP BY ALL
),
zoh AS (SELECT event_type, CAST(t_start AS DOUBLE) AS t_start, n_samples, round(coverage, 6) AS coverage, n_samples >= 2 AND coverage >= 0.8::DOUBLE - 1e-12 AND NOT fell AS telemetry_ok, mean, events FROM windows)
"""
_SWEEP = """
sweep AS (
  SELECT event_type, round(pow(1.15::DOUBLE, step), 9) AS x, n, latency, n / latency AS power FROM (
    SELECT event_type, user_id % 10 AS step, CAST(count(*) AS DOUBLE) AS n, round(avg(value), 6) AS latency FROM events GROUP BY ALL
  )
),
points AS (
  SELECT *, lag(x) OVER w AS lo, lead(x) OVER w AS hi, lag(power) OVER w AS pl, lead(power) OVER w AS ph, lag(n) OVER w AS nl, max(power) OVER (PARTITION BY event_type) AS top
  FROM sweep WINDOW w AS (PARTITION BY event_type ORDER BY x)
),
peaks AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n_peaks, row_number() OVER (PARTITION BY event_type ORDER BY x) AS k FROM points WHERE power = top),
best AS (
  SELECT *, x - ((x - lo) * (x - lo) * (power - ph) - (x - hi) * (x - hi) * (power - pl)) / (2 * ((x - lo) * (power - ph) - (x - hi) * (power - pl))) AS vertex,
    hi / lo <= 1.15::DOUBLE * 1.15::DOUBLE * (1 + 1e-9) AS fits
  FROM peaks WHERE k = 1
)
"""
_CELL_KEY = {"arm": 1, "retriever": 3, "policy": 7, "topology": 11, "engine": 13, "model": 17, "family": 19}


def _axis(name: str) -> str:
    values = ig.AXES[name]
    return f"[{', '.join(repr(v) for v in values)}][(o_orderkey // {_CELL_KEY[name]}) % {len(values)} + 1] AS {name}"


_CELLS = f"""
cells AS (
  SELECT o_orderkey, {', '.join(map(_axis, ig.AXES))},
    CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 40 + 1) / 20.0::DOUBLE END AS budget_r, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 23 + 1) * 0.125::DOUBLE END AS rate_frac
  FROM orders
)
"""
_IN = lambda xs: "(" + ", ".join(repr(x) for x in xs) + ")"
_FAMILY = " OR ".join(f"(family = '{f}' AND arm NOT IN {_IN(arms)})" for f, arms in ig.FAMILY_ARMS.items())
_G = lambda c: f"regexp_replace(regexp_replace(printf('%.10f', {c}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_PREDICATE = """
predicates AS (
  SELECT doc_id, dataset, CASE WHEN reason IS NULL THEN value END AS predicate, reason FROM (
    SELECT *, CASE WHEN dataset = 'hpc' THEN 'no_predicate' WHEN NOT ok THEN 'not_ok' WHEN value IS NULL THEN 'missing_verdict' END AS reason FROM (
      SELECT *, CASE WHEN dataset = 'squad_v2' THEN em = 1 WHEN dataset = 'qasper' THEN gs >= 0.5::DOUBLE END AS value FROM (
        SELECT doc_id, ['squad_v2', 'qasper', 'hpc'][doc_id % 3 + 1] AS dataset, doc_id % 11 <> 0 AS ok, CASE WHEN doc_id % 4 <> 0 THEN quality END AS em, doc_id % 10 / 10.0::DOUBLE AS gs FROM labels
      )
    )
  )
)
"""

ORACLE = {
    "validity_counts": f"WITH {_LONG} SELECT cell, count(*) AS n, count(*) FILTER (k % 17 = 0) AS n_error, count(*) FILTER (k % 23 = 0) AS n_empty, count(*) FILTER (k % 17 <> 0 AND k % 23 <> 0 AND k % 11 <> 0) AS n_headline FROM long GROUP BY cell",
    "per_example_mean": f"WITH {_LONG} SELECT cell, example_id, round(value, 6) AS value, n_rows FROM per_example",
    "cell_summary": f"WITH {_LONG} SELECT cell, count(*) AS n_examples, CAST(sum(n_rows) AS BIGINT) AS n_rows, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(coalesce(stddev_samp(value), 0), 4) AS std FROM per_example GROUP BY cell",
    "mean_of_trial_means": f"WITH {_LONG} SELECT cell, round(avg(m), 4) AS mean_of_trial_means, count(*) AS n_trials FROM (SELECT cell, trial, avg(price) AS m FROM headline GROUP BY ALL) GROUP BY cell",
    "trial_aggregate": f"WITH {_LONG} SELECT trial, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS std, round(min(price), 4) AS min, round(max(price), 4) AS max, count(*) AS n FROM valid GROUP BY trial",
    "paired_deltas": f"WITH {_PAIRS} SELECT example_id, round(a, 7) AS a, round(b, 7) AS b, round(delta, 7) AS delta FROM pairs",
    "win_loss_tie": f"WITH {_PAIRS} SELECT count(delta) AS n_pairs, count(*) FILTER (delta > 100) AS wins, count(*) FILTER (delta < -100) AS losses, count(*) FILTER (abs(delta) <= 100) AS ties, count(*) FILTER (delta IS NULL) AS n_dropped, round(avg(delta), 4) AS mean_delta, round(median(delta), 4) AS median_delta FROM pairs",
    "sign_flip_share": f"WITH {_PAIRS}, m AS (SELECT median(delta) AS m FROM pairs) SELECT round(max(m), 4) AS median, round(avg(CASE WHEN m = 0 THEN (delta <> 0)::INT ELSE (sign(delta) = -sign(m))::INT END), 9) AS flip_share FROM pairs, m WHERE delta IS NOT NULL",
    "wilcoxon_pratt": f"""
WITH {_PAIRS},
ranked AS (SELECT *, rank() OVER (PARTITION BY contrast ORDER BY abs(a - b)) + (count(*) OVER (PARTITION BY contrast, abs(a - b)) - 1) / 2 AS r FROM contrasts),
tied AS (SELECT contrast, sum(t * t * t - t) AS ties FROM (SELECT contrast, CAST(count(*) AS DOUBLE) AS t FROM contrasts WHERE a <> b GROUP BY contrast, abs(a - b)) GROUP BY contrast),
sums AS (SELECT contrast, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (a = b) AS DOUBLE) AS z, coalesce(sum(r) FILTER (a > b), 0) AS w_plus, coalesce(sum(r) FILTER (a < b), 0) AS w_minus FROM ranked GROUP BY contrast),
moments AS (SELECT *, (n * (n + 1) - z * (z + 1)) / 4 AS w_mean, (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - ties / 2) / 24 AS w_var FROM sums JOIN tied USING (contrast))
SELECT contrast, CAST(n AS BIGINT) AS n_pairs, CAST(z AS BIGINT) AS n_zero, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(w_mean, 6) AS w_mean, round(w_var, 6) AS w_var, round(greatest(abs(w_plus - w_mean) - 0.5::DOUBLE, 0) / sqrt(w_var), 6) AS z FROM moments
""",
    "mannwhitney_cliffs": f"""
WITH {_LONG},
v AS (SELECT example_id % 4 AS contrast, cell, round(value / 1000) AS value FROM per_example WHERE cell IN ('A', 'N')),
ranked AS (SELECT *, rank() OVER (PARTITION BY contrast ORDER BY value) + (count(*) OVER (PARTITION BY contrast, value) - 1) / 2 AS r FROM v),
sums AS (SELECT contrast, count(*) FILTER (cell = 'A') AS n_a, count(*) FILTER (cell = 'N') AS n_b, sum(r) FILTER (cell = 'A') AS ra FROM ranked GROUP BY contrast)
SELECT contrast, n_a, n_b, ra - n_a * (n_a + 1) / 2 AS u, round(2 * (ra - n_a * (n_a + 1) / 2) / (n_a * n_b) - 1, 9) AS cliffs_delta FROM sums
""",
    "mcnemar_counts": f"""
WITH {_PAIRS}, b2 AS (SELECT contrast, a >= 38 AS a, b >= 38 AS b FROM contrasts)
SELECT contrast, count(*) AS n_pairs, count(*) FILTER (a AND b) AS n11, count(*) FILTER (NOT a AND NOT b) AS n00, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01, round((count(*) FILTER (a AND NOT b) - count(*) FILTER (NOT a AND b)) / count(*), 9) AS diff FROM b2 GROUP BY contrast
""",
    "mcnemar_test": f"""
WITH {_PAIRS}, b2 AS (SELECT contrast, a >= 38 AS a, b >= 38 AS b FROM contrasts),
counts AS (SELECT contrast, count(*) AS n_pairs, count(*) FILTER (a AND b) AS n11, count(*) FILTER (NOT a AND NOT b) AS n00, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01 FROM b2 GROUP BY contrast),
heads AS (SELECT contrast, j, exp(lgamma(n10 + n01 + 1) - lgamma(j + 1) - lgamma(n10 + n01 - j + 1) - (n10 + n01) * ln(2)) AS p, j >= n10 AS above, j <= n10 AS under FROM (SELECT *, unnest(range(0, n10 + n01 + 1)) AS j FROM counts)),
tails AS (SELECT contrast, sum(p) FILTER (above) AS upper, sum(p) FILTER (under) AS lower FROM heads GROUP BY contrast)
SELECT counts.*, round((n10 - n01) / n_pairs, 9) AS diff, round(least(1.0::DOUBLE, 2 * least(upper, lower)), 9) AS p FROM counts JOIN tails USING (contrast)
""",
    "lambda_star": f"""
WITH RECURSIVE {_SWEEP},
steps AS (SELECT event_type, x AS rate, n AS t, round(least(1.0::DOUBLE, n / latency), 9) >= 0.9::DOUBLE AS attained, row_number() OVER (PARTITION BY event_type ORDER BY x) AS k FROM sweep),
walk(event_type, k, held, last) AS (
  SELECT event_type, k, attained, CASE WHEN attained THEN t END FROM steps WHERE k = 1
  UNION ALL
  SELECT s.event_type, s.k, s.attained AND (last IS NULL OR t >= last), CASE WHEN s.attained AND (last IS NULL OR t >= last) THEN t ELSE last END FROM walk JOIN steps s ON s.event_type = walk.event_type AND s.k = walk.k + 1
),
told AS (SELECT event_type, k, rate, held, lead(rate) OVER w AS next, held AND NOT lead(held) OVER w AS breaks FROM walk JOIN steps USING (event_type, k) WINDOW w AS (PARTITION BY event_type ORDER BY k)),
own AS (SELECT event_type, max_by(rate, k) FILTER (breaks) AS broke, max_by(next, k) FILTER (breaks) AS beyond, max(rate) FILTER (held) AS sustained, min(rate) AS first, count(*) AS n_steps FROM told GROUP BY event_type)
SELECT event_type, CASE WHEN broke IS NOT NULL THEN 'ESTIMATED' WHEN sustained IS NULL THEN 'NONE_SUSTAINABLE' ELSE 'LADDER_EXHAUSTED' END AS label, broke AS lambda_star, coalesce(broke, sustained) AS sustained_rate, coalesce(beyond, CASE WHEN sustained IS NULL THEN first END) AS first_unsustainable, n_steps FROM own
""",
    "welch_stats": """
WITH m AS (SELECT CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS side, hour(ts) AS w, round(avg(value), 9) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
s AS (SELECT count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, avg(v) FILTER (side = 'a') - avg(v) FILTER (side = 'b') AS d, var_samp(v) FILTER (side = 'a') / count(*) FILTER (side = 'a') AS va, var_samp(v) FILTER (side = 'b') / count(*) FILTER (side = 'b') AS vb FROM m)
SELECT n_a, n_b, round(d, 6) AS mean_diff, round(d / sqrt(va + vb), 6) AS t, round((va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)), 6) AS df FROM s
""",
    "holm_adjust": f"WITH {_FAMILIES}, s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, seq) + 1) * p AS scaled FROM families) SELECT family, seq, round(least(1, max(scaled) OVER (PARTITION BY family ORDER BY p, seq ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM s",
    "bh_fdr": f"WITH {_FAMILIES}, s AS (SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, seq) AS scaled FROM families) SELECT family, seq, round(least(1, min(scaled) OVER (PARTITION BY family ORDER BY p DESC, seq DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_bh FROM s",
    "roc_auc": f"WITH {_SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scored) SELECT CAST(sum(quality) AS BIGINT) AS n_pos, CAST(count(*) - sum(quality) AS BIGINT) AS n_neg, round({_AUC}, 9) AS auc FROM r",
    "length_bin_auc": f"""
WITH {_SCORED}, b AS (SELECT *, CASE WHEN n_chars >= 4000 THEN '[4k, inf)' WHEN n_chars >= 1000 THEN '[1k, 4k)' WHEN n_chars >= 500 THEN '[500, 1k)' ELSE '[0, 500)' END AS bin FROM scored),
r AS (SELECT *, rank() OVER (PARTITION BY bin ORDER BY score) + (count(*) OVER (PARTITION BY bin, score) - 1) / 2 AS r FROM b)
SELECT bin, CAST(sum(quality) AS BIGINT) AS n_pos, CAST(count(*) - sum(quality) AS BIGINT) AS n_neg, CASE WHEN sum(quality) * (count(*) - sum(quality)) > 0 THEN round({_AUC}, 9) END AS auc FROM r GROUP BY bin
""",
    "tau_precision_floor": f"""
WITH {_SCORED}, c AS (SELECT score, count(*) AS t, sum(quality) AS pos FROM scored GROUP BY score),
tail AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(t) OVER (ORDER BY score DESC) AS n, sum(pos) OVER () AS p, sum(t) OVER () AS all_n FROM c),
best AS (SELECT * FROM tail WHERE tp / n >= 0.85::DOUBLE - 1e-12 ORDER BY score LIMIT 1)
SELECT round(score, 9) AS tau, round(tp / n, 9) AS precision, round(tp / p, 9) AS recall, round(1 - (n - tp) / (all_n - p), 9) AS specificity, CAST(n AS BIGINT) AS n_predicted FROM best
""",
    "tau_balanced_accuracy": f"""
WITH {_SCORED}, taus AS (SELECT DISTINCT score AS tau FROM scored),
swept AS (SELECT tau, round((count(*) FILTER (score < tau AND toxic = 1) / sum(toxic) + 1 - count(*) FILTER (score < tau AND toxic = 0) / count(*) FILTER (toxic = 0)) / 2, 12) AS ba FROM taus, scored GROUP BY tau),
top AS (SELECT max(ba) AS best FROM swept)
SELECT round(min(tau) FILTER (ba = best), 9) AS tau, round(max(best), 9) AS balanced_accuracy, round(min(tau) FILTER (ba >= best - 0.01::DOUBLE), 9) AS band_low, round(max(tau) FILTER (ba >= best - 0.01::DOUBLE), 9) AS band_high FROM swept, top
""",
    "corrected_rate": "SELECT round(avg(toxic), 9) AS apparent, round(greatest(0, least(1, (avg(toxic) + 0.97::DOUBLE - 1) / (0.9::DOUBLE + 0.97::DOUBLE - 1))), 9) AS corrected FROM labels",
    "drift_audit": f"WITH {_SCORED}, b AS (SELECT score, score + CASE WHEN doc_id % 10 = 0 THEN 0.25::DOUBLE ELSE 0 END AS again FROM scored) SELECT count(*) AS n, round(avg(abs(score - again)), 9) AS mean_abs_delta, round(avg(((score >= 7) <> (again >= 7))::INT), 9) AS flip_rate FROM b",
    "collision_probability": "SELECT o_orderstatus, round(sum(c * c) / (sum(c) * sum(c)), 9) AS collision_probability FROM (SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS DOUBLE) AS c FROM orders GROUP BY ALL) GROUP BY o_orderstatus",
    "goodput_window": f"""
WITH {_REQUESTS}, c AS (SELECT window_id, count(*) AS n_issued, count(*) FILTER (ok) AS n_completed, count(*) FILTER (timely) AS n_timely, count(*) FILTER (veridical) AS n_veridical, count(*) FILTER (timely AND veridical) AS n_yield FROM requests GROUP BY window_id)
SELECT CAST(window_id AS INTEGER) AS window_id, n_issued, n_completed, n_timely, n_veridical, n_yield, round(n_completed / n_issued, 9) AS attainment, round(n_completed / 3600, 9) AS throughput_rps, round(n_timely / 3600, 9) AS goodput_rps, round(n_yield / 3600, 9) AS yield_rps,
  round(n_timely / n_issued * (n_veridical / n_issued), 9) AS independence_null_frac, round(n_yield / n_issued - n_timely / n_issued * (n_veridical / n_issued), 9) AS covariance_gap, round(n_timely / n_issued - n_yield / n_issued, 9) AS truth_tax_frac, round(n_timely / 3600 - n_yield / 3600, 9) AS truth_tax_rps FROM c
""",
    "window_trim": f"WITH {_REQUESTS} SELECT CAST(window_id AS INTEGER) AS window_id, count(*) AS n, min(arrival_s) AS first_s, max(arrival_s) AS last_s FROM requests WHERE arrival_s >= 600 AND arrival_s < 2400 GROUP BY window_id",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS avg, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "performance_summary": """
WITH r AS (SELECT event_type, value * 2 AS ttft, value * 10 AS total, event_id % 40 AS tokens FROM events WHERE event_id % 19 <> 0),
t AS (SELECT *, CASE WHEN tokens > 1 AND total > ttft THEN (total - ttft) / (tokens - 1) END AS tpot FROM r)
SELECT event_type, count(*) AS n, round(count(*) / (sum(total) / 1000), 6) AS qps, round(sum(tokens) / (sum(total) / 1000), 6) AS tps, round(avg(ttft), 6) AS avg_ttft, round(quantile_cont(ttft, 0.95), 6) AS p95_ttft, round(avg(tpot), 6) AS avg_tpot, round(quantile_cont(tpot, 0.99), 6) AS p99_tpot, round(quantile_cont(total, 0.5), 6) AS p50_latency FROM t GROUP BY event_type
""",
    "slo_floor": f"WITH {_REQUESTS} SELECT event_type, count(*) AS n, round(quantile_cont(ttft_s * 1000, 0.5) / 1000, 9) AS ttft_s, round(quantile_cont(tpot_s * 1000, 0.5) / 1000, 9) AS tpot_s FROM requests WHERE ok GROUP BY event_type",
    "zoh_time_average": f"WITH {_ZOH} SELECT event_type, t_start, n_samples, coverage, telemetry_ok, CASE WHEN telemetry_ok THEN round(mean, 6) END AS rho_kv, CASE WHEN telemetry_ok THEN events END AS scarcity_events FROM zoh",
    "regime_label": f"""
WITH {_ZOH} SELECT event_type, t_start, CASE WHEN NOT telemetry_ok THEN 'UNKNOWN_TELEMETRY' WHEN round(1 - n_samples % 5 / 30, 6) < 0.9::DOUBLE THEN 'PAST_CLIFF' WHEN round(mean, 6) * 2 < 0.9::DOUBLE OR events = 0 THEN 'UNPRESSURED' ELSE 'IN_REGIME' END AS regime FROM zoh
""",
    "knee": f"""
WITH {_SWEEP} SELECT event_type,
  CASE WHEN n_peaks > 1 THEN 'INCONCLUSIVE_AT_RESOLUTION' WHEN lo IS NULL OR hi IS NULL THEN 'NOT_BRACKETED' WHEN NOT fits THEN 'INCONCLUSIVE_AT_RESOLUTION' ELSE 'ESTIMATED' END AS label,
  CASE WHEN n_peaks = 1 AND fits THEN round(greatest(lo, least(hi, vertex)), 6) END AS onset_rate, round(x, 6) AS grid_rate,
  CASE WHEN n_peaks = 1 AND lo IS NOT NULL AND hi IS NOT NULL THEN round(lo, 6) END AS lo, CASE WHEN n_peaks = 1 AND lo IS NOT NULL AND hi IS NOT NULL THEN round(hi, 6) END AS hi FROM best
""",
    "cliff": f"""
WITH {_SWEEP}, falls AS (SELECT event_type, x AS hi, lo, row_number() OVER (PARTITION BY event_type ORDER BY x) AS k, hi / lo AS unused FROM points WHERE n < nl),
types AS (SELECT DISTINCT event_type FROM sweep)
SELECT event_type, CASE WHEN f.hi IS NULL THEN 'NOT_OBSERVED' WHEN f.hi / f.lo <= 1.15::DOUBLE * 1.15::DOUBLE * (1 + 1e-9) THEN 'ESTIMATED' ELSE 'INCONCLUSIVE_AT_RESOLUTION' END AS label,
  CASE WHEN f.hi / f.lo <= 1.15::DOUBLE * 1.15::DOUBLE * (1 + 1e-9) THEN round(f.hi, 6) END AS onset_rate, round(f.hi, 6) AS grid_rate, round(f.lo, 6) AS lo, round(f.hi, 6) AS hi
FROM types LEFT JOIN (SELECT * FROM falls WHERE k = 1) f USING (event_type)
""",
    "grid_onset": f"WITH {_SWEEP} SELECT event_type, CASE WHEN lo IS NULL OR hi IS NULL THEN 'INCONCLUSIVE-AT-RESOLUTION' ELSE 'ESTIMATED' END AS label, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN round(CASE WHEN power = pl AND power = ph THEN x ELSE greatest(lo, least(hi, vertex)) END, 6) END AS onset_rate, round(x, 6) AS grid_rate FROM best",
    "staleness_rates": """
WITH r AS (SELECT event_type, event_id % 3 <> 0 AS served, CASE WHEN event_id % 13 <> 0 THEN value > 20 END AS g, event_id % 4 = 0 AS stale FROM events)
SELECT event_type, round(count(*) FILTER (g IS NOT NULL AND served AND NOT g) / count(*) FILTER (g IS NOT NULL), 9) AS unsafe_served_rate, round(count(*) FILTER (served) / count(*), 9) AS answer_hit_rate,
  round(count(*) FILTER (served AND NOT g) / count(*) FILTER (served AND g IS NOT NULL), 9) AS false_hit_rate, round(count(*) FILTER (served AND stale AND NOT g) / count(*) FILTER (served AND stale AND g IS NOT NULL), 9) AS stale_hit_rate FROM r GROUP BY event_type
""",
    "select_stale": "SELECT event_id, CAST('0x' || sha1('42:' || event_id)[1:8] AS BIGINT) / 4294967295.0::DOUBLE < 0.3::DOUBLE AS stale FROM events",
    "cache_hit_metrics": """
WITH r AS (SELECT event_type, value, CASE WHEN event_id % 5 = 0 THEN 'remote' WHEN event_id % 7 = 0 THEN 'miss' ELSE 'local' END AS kind FROM events)
SELECT event_type, count(*) AS n_accesses, round(count(*) FILTER (kind = 'local') / count(*), 6) AS local_ratio, round(count(*) FILTER (kind = 'remote') / count(*), 6) AS remote_ratio, round(count(*) FILTER (kind = 'miss') / count(*), 6) AS miss_ratio, round(avg(value) FILTER (kind = 'remote'), 6) AS avg_remote_fetch_ms, round(sum(value * 1024) FILTER (kind = 'remote'), 2) AS bytes_moved FROM r GROUP BY event_type
""",
    "prompt_cache_summary": """
WITH r AS (SELECT event_type, event_id % 900 + 100 AS prompt, CASE WHEN event_id % 6 <> 0 THEN event_id % 90 END AS cached FROM events)
SELECT event_type, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, CAST(sum(cached) AS BIGINT) AS cached_tokens, round(sum(cached) / sum(prompt), 9) AS cached_ratio, round(avg((cached > 0)::INT), 9) AS request_rate, round(median(prompt - cached), 9) AS median_uncached, count(*) FILTER (cached IS NULL) AS n_missing FROM r GROUP BY event_type
""",
    "gauge_summary": "SELECT event_type, max(value) AS value_peak, round(avg(value), 4) AS value_avg, max_by(value, epoch_us(ts)) AS value_last, max(event_id) AS event_id_max, max_by(user_id, epoch_us(ts)) - min_by(user_id, epoch_us(ts)) AS energy FROM events GROUP BY event_type",
    "kv_footprint": "SELECT doc_id, n_chars * 81920 * [1, 2, 4][doc_id % 3 + 1] AS kv_bytes, n_chars * 23040 * [1, 2, 4][doc_id % 3 + 1] AS latent_bytes FROM documents",
    "pareto_frontier": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_retailprice <= p.p_retailprice AND q.p_size <= p.p_size AND (q.p_retailprice < p.p_retailprice OR q.p_size < p.p_size))",
    "minmax_trilemma": "SELECT s_suppkey, round(CASE WHEN hi = lo THEN 50 ELSE 100 * (s_acctbal - lo) / (hi - lo) END, 6) AS score FROM (SELECT *, min(s_acctbal) OVER w AS lo, max(s_acctbal) OVER w AS hi FROM supplier WINDOW w AS (PARTITION BY s_nationkey))",
    "identity_join": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS repeat, o_totalprice, o_orderstatus FROM orders",
    "reconciliation": """
WITH l AS (SELECT o_orderkey AS key, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1), r AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1),
b AS (SELECT coalesce(l.n, 0) AS nl, coalesce(r.n, 0) AS nr FROM l FULL JOIN r USING (key))
SELECT CASE WHEN nl > 1 OR nr > 1 THEN 'DUPLICATE' WHEN nr = 0 THEN 'LEFT_ONLY' WHEN nl = 0 THEN 'RIGHT_ONLY' ELSE 'MATCHED' END AS status, count(*) AS n_keys, CAST(sum(nr) AS BIGINT) AS n_rows FROM b GROUP BY 1
""",
    "duplicate_census": "SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "coverage_antijoin": "SELECT c_custkey AS key, 'MISSING' AS finding FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + 3 FROM orders) UNION ALL SELECT DISTINCT o_custkey + 3, 'EXTRA' FROM orders WHERE o_custkey + 3 NOT IN (SELECT c_custkey FROM customer)",
    "keep_last": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus, count(*) - 1 AS n_dropped FROM orders GROUP BY o_custkey",
    "merge_scores": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CAST(n_chars AS DOUBLE) ELSE coalesce(s, CAST(n_chars AS DOUBLE)) END AS score FROM documents LEFT JOIN (SELECT doc_id, CAST(max(quality) AS DOUBLE) AS s FROM labels GROUP BY doc_id) USING (doc_id)",
    "window_predicate": f"WITH {_PREDICATE} SELECT * FROM predicates",
    "predicate_summary": f"WITH {_PREDICATE} SELECT dataset, count(*) AS n, coalesce(count(*) FILTER (predicate), 0) AS n_true, coalesce(count(*) FILTER (NOT predicate), 0) AS n_false, count(*) FILTER (predicate IS NULL) AS n_null, round(count(*) FILTER (predicate IS NULL) / count(*), 9) AS null_fraction FROM predicates GROUP BY dataset",
    "quality_aggregate": f"""
WITH {_SCORED}, u AS (SELECT quality, 'score' AS metric, CASE WHEN doc_id % 3 <> 0 THEN score END AS v FROM scored UNION ALL SELECT quality, 'toxic', toxic FROM scored)
SELECT quality, metric, round(avg(v), 9) AS mean, count(v) AS n, count(*) FILTER (v IS NULL) AS n_none FROM u GROUP BY ALL
""",
    "blinded_labels": "SELECT r_regionkey, r_name FROM region",
    "cell_violations": f"""
WITH {_CELLS} SELECT o_orderkey, CAST(
  (arm LIKE 'retr-%' AND retriever = 'none')::INT + (arm NOT LIKE 'retr-%' AND retriever <> 'none')::INT + ({_FAMILY})::INT + (policy <> 'none' AND family NOT IN ('F2', 'F3'))::INT
  + (engine = 'hf' AND family <> 'F1')::INT + (engine = 'hf' AND topology <> 'single')::INT + (engine = 'lmdeploy' AND model NOT IN ('qwen3-14b', 'llama-3.3-70b'))::INT
  + (topology = 'pd' AND family <> 'DIST')::INT + (family = 'DIST' AND topology = 'single')::INT + (budget_r IS NOT NULL AND family = 'F1')::INT + (rate_frac IS NOT NULL AND family = 'F1')::INT AS BIGINT) AS n_violations, ({_FAMILY}) AS arm_family FROM cells
""",
    "row_keys": f"""
WITH {_CELLS} SELECT o_orderkey, concat_ws('|', {', '.join(ig.AXES)}, 'r' || {_G('budget_r')}, 'lam' || {_G('rate_frac')}) AS row_key, model, budget_r, rate_frac FROM cells
""",
    "baseline_cells": "SELECT s_suppkey, baseline, arm, retriever, reuse FROM (SELECT s_suppkey, 'B' || (s_suppkey % 12 + 1) AS baseline FROM supplier) JOIN (VALUES " + ", ".join(str(r) for r in ig.BASELINES) + ") b(baseline, arm, retriever, reuse) USING (baseline)",
    "family_map": "SELECT n_nationkey AS contrast_id, CASE WHEN n_regionkey = 0 THEN 'primary' ELSE 'secondary' END AS tier, metric, dataset, CASE WHEN n_regionkey = 0 THEN 'primary' ELSE 'secondary' END || ':' || n_nationkey || ':' || metric AS family_id FROM nation, (VALUES ('ttft_ms'), ('predicate')) m(metric), (VALUES ('squad_v2'), ('qasper')) d(dataset)",
    "gatekeeping": """
WITH legs AS (SELECT n_regionkey AS chain_order, 'E' || n_regionkey AS endpoint, max(p) AS p, count(*) AS n_legs, count(*) FILTER (p IS NULL) AS n_missing FROM (SELECT *, CASE WHEN n_nationkey <> 17 THEN (n_nationkey % 6) / 100.0::DOUBLE END AS p FROM nation) GROUP BY ALL),
t AS (SELECT *, n_missing = 0 AND p < 0.05::DOUBLE AS passed FROM legs),
o AS (SELECT *, coalesce(bool_and(passed) OVER (ORDER BY chain_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS open FROM t)
SELECT chain_order, endpoint, n_legs, n_missing, CASE WHEN n_missing = 0 THEN p END AS p, CASE WHEN NOT open THEN 'NOT_TESTED' WHEN n_missing > 0 THEN 'MISSING_LEG' WHEN passed THEN 'REJECTED' ELSE 'NOT_REJECTED' END AS status FROM o
""",
}
