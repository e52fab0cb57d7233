"""SQL building blocks stating the clean windows, limits and classes."""

from __future__ import annotations

from catalog.base import W, center_scale
from catalog.windows import deviation_sql


def joined(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def best_window(scores: str, size: str, need: str = "w") -> str:
    """CTE ``bw``: rows with rolling mean and whether they are in the best window."""
    frame = "OVER (ORDER BY ts ROWS BETWEEN w - 1 PRECEDING AND CURRENT ROW)"
    return (
        f"bn AS (SELECT count(*) AS n FROM {scores}), bw0 AS (SELECT CAST({size} AS BIGINT) AS w FROM bn), "
        f"bw1 AS (SELECT s.*, w, row_number() OVER (ORDER BY ts) AS pos FROM {scores} s, bw0), "
        f"bw2 AS (SELECT *, CASE WHEN count(score) {frame} >= {need} THEN avg(score) {frame} END AS rolling FROM bw1), "
        "bw3 AS (SELECT pos AS best_end FROM bw2 WHERE rolling IS NOT NULL ORDER BY round(rolling, 9), pos LIMIT 1), "
        "bw AS (SELECT bw2.*, pos BETWEEN best_end - w + 1 AND best_end AS in_window FROM bw2, bw3)"
    )


def stability(src: str) -> str:
    """CTE ``sc``: ts, score."""
    return ", ".join(
        [
            center_scale(src, "value", "st", "ladder", "1e-12"),
            f"sz0 AS (SELECT s.*, (value - center) / scale AS z FROM {src} s JOIN st USING (tag))",
            f"sz1 AS (SELECT *, abs(z - lag(z) OVER ({W})) AS dz FROM sz0)",
            "sr AS (SELECT ts, median(CASE WHEN z IS NOT NULL THEN least(abs(z), 10) END) AS lv, "
            "median(CASE WHEN dz IS NOT NULL THEN least(dz, 10) END) AS ch FROM sz1 GROUP BY ts)",
            "sf AS (SELECT median(lv) AS ml, median(ch) AS mc FROM sr)",
            "sc AS (SELECT ts, 0.75 * coalesce(lv, ml) + 0.25 * coalesce(ch, mc) AS score FROM sr, sf)",
        ]
    )


def auto_clean(src: str) -> str:
    """CTE ``ac``: ts, score, rolling, clean."""
    return ", ".join(
        [
            stability(src),
            best_window(
                "sc",
                "least(greatest(round_even(n * 0.15, 0), 30), greatest(least(floor(n * 0.5), n), 30), n)",
                "greatest(3, floor(w * 0.7))",
            ),
            "cut AS (SELECT quantile_cont(score, 0.85) AS cut FROM bw WHERE in_window)",
            "kept AS (SELECT count(*) AS kept FROM bw, cut WHERE in_window AND score <= cut)",
            "ac AS (SELECT ts, score, rolling, CASE WHEN n <= 30 THEN TRUE WHEN kept >= 30 THEN in_window AND score <= cut ELSE in_window END AS clean FROM bw, cut, kept, bn)",
        ]
    )


def clean_limits(src: str, rows: str) -> str:
    """CTE ``lim``: std limits with fallback for tags with few clean readings."""
    return ", ".join(
        [
            f"lm0 AS (SELECT s.*, CASE WHEN r.clean THEN value END AS c FROM {src} s LEFT JOIN {rows} r USING (ts))",
            "lm1 AS (SELECT tag, count(c) AS clean_count, min(c) AS clean_min, max(c) AS clean_max, count(c) < 10 AS fallback_used FROM lm0 GROUP BY tag)",
            "lm2 AS (SELECT lm0.*, CASE WHEN fallback_used THEN value ELSE c END AS b FROM lm0 JOIN lm1 USING (tag))",
            center_scale("lm2", "b", "lm3", "ladder", "1e-12"),
            "lim AS (SELECT tag, mean AS center, CASE WHEN std > 1e-12 THEN std ELSE scale END AS scale, n AS baseline_count, "
            "clean_count, clean_min, clean_max, fallback_used FROM lm3 JOIN lm1 USING (tag) WHERE n > 0)",
        ]
    )


def z_classes(src: str, limits: str, d: str = "3.0", a: str = "3.5", s: str = "5.0") -> str:
    """CTE ``cls``: z ladder on limits."""
    return (
        f"cz AS (SELECT s.ts, s.tag, s.value, (value - center) / scale AS value_z, {d} AS dz, {a} AS az, {s} AS sz FROM {src} s JOIN {limits} USING (tag)), "
        "cc1 AS (SELECT *, abs(value_z) AS abs_z, CASE WHEN abs(value_z) >= sz THEN 'Strong Anomaly' WHEN abs(value_z) >= az THEN 'Drift + Anomaly' "
        "WHEN abs(value_z) >= dz THEN 'Drift' ELSE 'Normal' END AS final_class FROM cz), "
        "cls AS (SELECT *, CASE WHEN final_class = 'Normal' THEN 'Normal' ELSE 'Abnormal' END AS final_status, "
        "CASE WHEN final_class = 'Normal' THEN 'NORMAL' WHEN value_z > 0 THEN 'UP' ELSE 'DOWN' END AS direction, "
        "CASE WHEN final_class = 'Normal' THEN 'Within_Limits' ELSE replace(replace(final_class, ' + ', '_'), ' ', '_') || "
        "CASE WHEN value_z > 0 THEN '_Upper_Limit' ELSE '_Lower_Limit' END END AS limit_crossed FROM cc1)"
    )


def level_and_jump(src: str, level: str = "3.5", jump: str = "4.0") -> str:
    """CTE ``lj``: ts, level_bad, jump_bad."""
    return ", ".join(
        [
            f"jd AS (SELECT *, coalesce(abs(value - lag(value) OVER ({W})), 0.0) AS jmp FROM {src})",
            center_scale("jd", "value", "jl", "unit"),
            center_scale("jd", "jmp", "jj", "unit"),
            f"tagn AS (SELECT count(DISTINCT tag) AS tn FROM {src})",
            f"lj AS (SELECT ts, count(*) FILTER (abs((value - jl.center) / jl.scale) > {level}) / max(tn) AS level_bad, "
            f"count(*) FILTER (abs((jmp - jj.center) / jj.scale) > {jump}) / max(tn) AS jump_bad "
            "FROM jd JOIN jl USING (tag) JOIN jj USING (tag), tagn GROUP BY ts)",
        ]
    )


def anchored(src: str) -> str:
    """CTE ``bw`` with the anchored clean window."""
    return ", ".join(
        [
            level_and_jump(src),
            "sc AS (SELECT *, 0.75 * level_bad + 0.25 * jump_bad + CASE WHEN level_bad > 0.10 THEN 0.25 ELSE 0.0 END AS score FROM lj)",
            best_window("sc", "CASE WHEN greatest(30, least(180, floor(n * 0.12))) >= n THEN greatest(5, floor(n * 0.25)) ELSE greatest(30, least(180, floor(n * 0.12))) END"),
        ]
    )


def deviation_window(src: str) -> str:
    """CTEs ``feat`` and ``bw``."""
    return ", ".join(
        [
            deviation_sql(src),
            f"tagn AS (SELECT count(DISTINCT tag) AS tn FROM {src})",
            "sh AS (SELECT ts, count(*) FILTER (abs(level_z) > 3.5) / max(tn) AS level_bad, count(*) FILTER (abs(spike_z) > 4) / max(tn) AS spike_bad, "
            "count(*) FILTER (abs(change_z) > 4) / max(tn) AS change_bad, count(*) FILTER (abs(volatility_z) > 4) / max(tn) AS volatility_bad, "
            "count(value) / max(tn) AS present FROM feat, tagn GROUP BY ts)",
            "sc AS (SELECT *, 0.35 * level_bad + 0.25 * spike_bad + 0.25 * change_bad + 0.10 * volatility_bad + 0.05 * (1 - present) AS score FROM sh)",
            best_window("sc", "CASE WHEN greatest(30, least(200, floor(n * 0.15))) >= n THEN greatest(5, floor(n * 0.30)) ELSE greatest(30, least(200, floor(n * 0.15))) END"),
        ]
    )


def stable_run(src: str) -> str:
    """CTE ``sr``: ts, score, stable, run_length, clean."""
    return ", ".join(
        [
            f"jd AS (SELECT *, value - lag(value) OVER ({W}) AS delta FROM {src})",
            "jd0 AS (SELECT *, coalesce(delta, 0.0) AS d0 FROM jd)",
            center_scale("jd0", "value", "jl"),
            center_scale("jd0", "d0", "jj"),
            f"tagn AS (SELECT count(DISTINCT tag) AS tn FROM {src})",
            "lj AS (SELECT ts, count(*) FILTER (abs((value - jl.center) / jl.scale) > 3.5) / max(tn) AS level_bad, "
            "count(*) FILTER (abs((d0 - jj.center) / jj.scale) > 4.0) / max(tn) AS step_bad "
            "FROM jd0 JOIN jl USING (tag) JOIN jj USING (tag), tagn GROUP BY ts)",
            "s0 AS (SELECT *, 0.5 * level_bad + 0.25 * step_bad + 0.25 * step_bad AS score FROM lj)",
            "s1 AS (SELECT *, (SELECT quantile_cont(score, 0.35) FROM s0) AS cutoff FROM s0)",
            "s2 AS (SELECT *, score <= cutoff AND step_bad <= 0.05 AS stable, row_number() OVER (ORDER BY ts) AS pos, row_number() OVER (ORDER BY score, ts) AS rnk FROM s1)",
            "s3 AS (SELECT *, CASE WHEN stable IS DISTINCT FROM lag(stable) OVER (ORDER BY ts) THEN 1 ELSE 0 END AS st FROM s2)",
            "s4 AS (SELECT *, sum(st) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS gid FROM s3)",
            "s5 AS (SELECT *, CASE WHEN stable THEN count(*) OVER (PARTITION BY gid) ELSE 0 END AS run_length FROM s4)",
            "s6 AS (SELECT run_length AS best_len, gid AS best_gid FROM s5 ORDER BY run_length DESC, pos LIMIT 1)",
            "sr AS (SELECT ts, level_bad, step_bad, score, cutoff, stable, run_length, CASE WHEN best_len >= 30 THEN stable AND gid = best_gid "
            "ELSE rnk <= least(greatest(30, floor((SELECT count(*) FROM s0) * 0.10)), (SELECT count(*) FROM s0)) END AS clean FROM s5, s6)",
        ]
    )


def core(src: str, ref: str, out: str) -> str:
    """CTE ``out``: source plus ``k``, the reference value kept after the core trim."""
    return ", ".join(
        [
            center_scale(src, ref, f"{out}_c"),
            f"{out}_n AS (SELECT s.*, CASE WHEN abs(({ref} - center) / scale) <= 4.0 THEN {ref} END AS near, n AS rn FROM {src} s JOIN {out}_c USING (tag))",
            f"{out}_k AS (SELECT tag, count(near) >= greatest(10, floor(any_value(rn) * 0.60)) AS enough FROM {out}_n GROUP BY tag)",
            f"{out} AS (SELECT s.*, CASE WHEN enough THEN near ELSE {ref} END AS k FROM {out}_n s JOIN {out}_k USING (tag))",
        ]
    )


def band(src: str, ref: str, k: str, margin: str, low: str, high: str, out: str = "band") -> str:
    """CTE ``out``: final reference statistics and widened limits."""
    return ", ".join(
        [
            center_scale(src, ref, f"{out}_c"),
            f"{out}_q AS (SELECT tag, quantile_cont({ref}, {low}) AS ql, quantile_cont({ref}, {high}) AS qh FROM {src} GROUP BY tag)",
            f"{out}_l AS (SELECT c.*, least(center - {k} * scale, ql) AS lo, greatest(center + {k} * scale, qh) AS hi FROM {out}_c c JOIN {out}_q USING (tag) WHERE n > 0)",
            f"{out}_w AS (SELECT *, CASE WHEN hi - lo <= 1e-9 THEN greatest(scale, 1e-9) ELSE hi - lo END AS width FROM {out}_l)",
            f"{out} AS (SELECT tag, n AS reference_count, mean AS reference_mean, center AS reference_median, CASE WHEN std >= 1e-9 THEN std ELSE scale END AS reference_std, "
            f"scale AS reference_scale, lo - {margin} * width AS lower_limit, hi + {margin} * width AS upper_limit FROM {out}_w)",
        ]
    )


def similar_history(src: str) -> str:
    """CTE ``band`` from the anchored window (needs ``bw``)."""
    return ", ".join(
        [
            f"h0 AS (SELECT s.*, CASE WHEN bw.in_window THEN value END AS c FROM {src} s JOIN bw USING (ts))",
            center_scale("h0", "c", "hc"),
            "hq AS (SELECT tag, quantile_cont(c, 0.05) AS q5, quantile_cont(c, 0.95) AS q95, quantile_cont(c, 0.75) - quantile_cont(c, 0.25) AS iqr FROM h0 GROUP BY tag)",
            "ha AS (SELECT hc.*, q5, q95, 0.10 * greatest(q95 - q5, CASE WHEN iqr >= 1e-9 THEN iqr ELSE scale END, scale) AS reach FROM hc JOIN hq USING (tag) WHERE n > 0)",
            "h1 AS (SELECT h0.*, coalesce(abs((value - center) / scale) <= 2.5 OR value BETWEEN q5 - reach AND q95 + reach, FALSE) AS m1, "
            "coalesce(abs((value - center) / scale) <= 3.5 OR value BETWEEN q5 - reach AND q95 + reach, FALSE) AS m2 FROM h0 JOIN ha USING (tag))",
            "h2 AS (SELECT tag, count_if(m1) < greatest(30, floor(count(value) * 0.05)) AS relax, count_if(m1) AS n1, count_if(m2) AS n2 FROM h1 GROUP BY tag)",
            "h3 AS (SELECT h1.*, CASE WHEN CASE WHEN relax THEN n2 ELSE n1 END < 15 THEN c WHEN CASE WHEN relax THEN m2 ELSE m1 END THEN value END AS r FROM h1 JOIN h2 USING (tag))",
            core("h3", "r", "h4"),
            band("h4", "k", "3.5", "0.15", "0.005", "0.995"),
        ]
    )


def clean_only(src: str) -> str:
    return ", ".join(
        [
            f"h3 AS (SELECT s.*, CASE WHEN bw.in_window THEN value END AS r FROM {src} s JOIN bw USING (ts))",
            core("h3", "r", "h4"),
            band("h4", "k", "3.5", "0.15", "0.005", "0.995"),
        ]
    )


def outside_band(src: str) -> str:
    """CTE ``cls`` on ``band``."""
    f = "OVER (PARTITION BY tag ORDER BY ts, row_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    return ", ".join(
        [
            f"o0 AS (SELECT s.*, band.* EXCLUDE (tag), (CASE WHEN value < lower_limit THEN value - lower_limit WHEN value > upper_limit THEN value - upper_limit ELSE 0.0 END) "
            f"/ greatest(reference_scale, 1e-9) AS distance_z, coalesce(value < lower_limit OR value > upper_limit, FALSE) AS raw_outside FROM {src} s JOIN band USING (tag))",
            f"o1 AS (SELECT *, sum(CAST(raw_outside AS INT)) {f} >= 2 AS persistent_outside FROM o0)",
            "cls AS (SELECT *, CASE WHEN NOT (abs(distance_z) >= 5 OR (raw_outside AND persistent_outside)) THEN 'Normal' WHEN abs(distance_z) >= 5 THEN 'Strong Anomaly' "
            "WHEN abs(distance_z) < 3.5 THEN 'Drift' ELSE 'Drift + Anomaly' END AS final_class FROM o1)",
        ]
    )


def spike_free(src: str) -> str:
    """CTE ``band`` and ``v2`` (readings with is_reference); needs ``feat`` and ``bw``."""
    return ", ".join(
        [
            "vc AS (SELECT quantile_cont(score, 0.60) AS cut FROM bw)",
            "v0 AS (SELECT feat.*, bw.in_window AS clean, score <= cut AS calm, CASE WHEN bw.in_window THEN value END AS c FROM feat JOIN bw USING (ts), vc)",
            center_scale("v0", "c", "va"),
            "v1 AS (SELECT v0.*, coalesce((abs((value - center) / scale) <= 2.75 AND abs(spike_z) <= 4 AND abs(change_z) <= 4 AND calm) OR clean, FALSE) AND value IS NOT NULL AS m "
            "FROM v0 JOIN va USING (tag) WHERE n > 0)",
            "vm AS (SELECT tag, count_if(m) AS mn FROM v1 GROUP BY tag)",
            "v2 AS (SELECT v1.*, CASE WHEN mn < 30 THEN c IS NOT NULL ELSE m END AS is_reference FROM v1 JOIN vm USING (tag))",
            "v3 AS (SELECT *, CASE WHEN is_reference THEN value END AS r FROM v2)",
            band("v3", "r", "3.5", "0.12", "0.01", "0.99"),
        ]
    )


def clean_like(src: str) -> str:
    """CTE ``cl``: clean-like limits; needs ``sr`` and ``jd``."""
    return ", ".join(
        [
            "k0 AS (SELECT jd.*, sr.clean, CASE WHEN sr.clean THEN value END AS c FROM jd JOIN sr USING (ts))",
            "kn AS (SELECT tag, count(c) AS cn FROM k0 GROUP BY tag)",
            "k1 AS (SELECT k0.*, CASE WHEN cn < 5 THEN value ELSE c END AS cv FROM k0 JOIN kn USING (tag))",
            center_scale("k1", "cv", "kc"),
            f"k2 AS (SELECT *, value - lag(value) OVER ({W}) AS stp FROM k0 WHERE clean)",
            center_scale("k2", "stp", "kd"),
            "k3 AS (SELECT k1.*, kc.center AS cm, kc.scale AS cs, kd.center AS dc, kd.scale AS ds, abs(cv - kc.center) AS ae FROM k1 JOIN kc USING (tag) LEFT JOIN kd USING (tag))",
            center_scale("k3", "ae", "ke"),
            "k4 AS (SELECT *, CASE WHEN abs((value - cm) / cs) <= 2.75 AND abs((coalesce(delta, 0.0) - dc) / ds) <= 4 THEN value END AS lk FROM k3)",
            "kl AS (SELECT tag, count(lk) AS ln FROM k4 GROUP BY tag)",
            "k5 AS (SELECT k4.*, CASE WHEN ln < 30 THEN cv ELSE lk END AS r FROM k4 JOIN kl USING (tag))",
            band("k5", "r", "3.5", "0.12", "0.01", "0.99"),
            "kq AS (SELECT tag, quantile_cont(r, 0.05) AS central_lower, quantile_cont(r, 0.95) AS central_upper FROM k5 GROUP BY tag)",
            "cl AS (SELECT band.*, central_lower, central_upper, kc.n AS clean_count, kc.center AS clean_median, kc.scale AS clean_scale, kd.center AS delta_center, "
            "kd.scale AS delta_scale, ke.center AS abs_error_center, ke.scale AS abs_error_scale FROM band JOIN kq USING (tag) JOIN kc USING (tag) LEFT JOIN kd USING (tag) JOIN ke USING (tag))",
        ]
    )


def bands(src: str) -> str:
    """CTE ``bd``: learned value bands; also ``lj``."""
    return ", ".join(
        [
            level_and_jump(src),
            "b0 AS (SELECT *, 0.75 * level_bad + 0.25 * jump_bad AS score FROM lj)",
            "b1 AS (SELECT *, score <= (SELECT quantile_cont(score, 0.45) FROM b0) AS stable FROM b0)",
            f"b2 AS (SELECT s.*, CASE WHEN stable THEN value END AS sv FROM {src} s JOIN b1 USING (ts))",
            "b3 AS (SELECT tag, count(sv) AS sn, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99 FROM b2 GROUP BY tag)",
            "b4 AS (SELECT tag, CASE WHEN sn < 20 THEN CASE WHEN value BETWEEN q01 AND q99 THEN value END ELSE sv END AS v FROM b2 JOIN b3 USING (tag))",
            "b5 AS (SELECT tag, v, v - lag(v) OVER (PARTITION BY tag ORDER BY v) AS gap FROM b4 WHERE v IS NOT NULL)",
            "b6 AS (SELECT tag, count(*) AS total, greatest(4 * quantile_cont(gap, 0.5) FILTER (gap > 0), 2 * quantile_cont(gap, 0.75) FILTER (gap > 0), 1e-9) AS thr FROM b5 GROUP BY tag)",
            "b7 AS (SELECT b5.*, total, sum(CASE WHEN total >= 20 AND gap > thr THEN 1 ELSE 0 END) OVER (PARTITION BY tag ORDER BY v ROWS UNBOUNDED PRECEDING) AS isle FROM b5 JOIN b6 USING (tag))",
            "b8 AS (SELECT tag, isle, count(*) AS n, min(v) AS first, any_value(total) AS total, any_value(total) < 20 OR count(*) >= 20 OR count(*) / any_value(total) >= 0.06 AS keep FROM b7 GROUP BY tag, isle)",
            "b9 AS (SELECT tag, isle, row_number() OVER (PARTITION BY tag ORDER BY n DESC, first) AS band_id FROM b8 WHERE keep)",
            "ba AS (SELECT tag FROM b8 GROUP BY tag HAVING count_if(keep) = 0)",
            "bb AS (SELECT b7.tag, v, total, coalesce(CASE WHEN ba.tag IS NOT NULL THEN 1 END, band_id) AS band_id FROM b7 LEFT JOIN b9 ON b7.tag = b9.tag AND b7.isle = b9.isle LEFT JOIN ba ON b7.tag = ba.tag)",
            "bc AS (SELECT tag, band_id, count(*) AS n, any_value(total) AS total, median(v) AS med, mad(v) AS mad, stddev_samp(v) AS std, "
            "quantile_cont(v, 0.01) AS q01, quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.95) AS q95, quantile_cont(v, 0.99) AS q99 FROM bb WHERE band_id <= 2 GROUP BY tag, band_id)",
            "be AS (SELECT *, CASE WHEN 1.4826 * mad >= 1e-9 THEN 1.4826 * mad WHEN std >= 1e-9 THEN std ELSE 1e-9 END AS scale FROM bc)",
            "bf AS (SELECT *, least(med - 3 * scale, q01) AS lo, greatest(med + 3 * scale, q99) AS hi FROM be)",
            "bd AS (SELECT tag, band_id, n AS band_count, n / total AS band_fraction, med AS band_median, scale AS band_scale, q01, q05, q95, q99, "
            "lo - 0.10 * CASE WHEN hi - lo <= 1e-9 THEN greatest(scale, 1e-9) ELSE hi - lo END AS lower_limit, "
            "hi + 0.10 * CASE WHEN hi - lo <= 1e-9 THEN greatest(scale, 1e-9) ELSE hi - lo END AS upper_limit FROM bf)",
        ]
    )


def nearest(src: str) -> str:
    """CTE ``nb``: readings with distance to the nearest band; needs ``bd``."""
    return (
        "n0 AS (SELECT s.ts, s.row_index, s.tag, s.value, b.band_id, b.lower_limit, b.upper_limit, CASE WHEN value < lower_limit THEN (value - lower_limit) / band_scale "
        f"WHEN value > upper_limit THEN (value - upper_limit) / band_scale ELSE 0.0 END AS dist FROM {src} s JOIN bd b USING (tag)), "
        "nb AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY ts, row_index, tag ORDER BY abs(dist), band_id) = 1)"
    )


def design(src: str, peers: str, k: int) -> str:
    """CTEs ``dk``, ``dz``: a target's readings y beside those of its peers x1.., and its number of peers."""
    xs = ", ".join(f"max(CASE WHEN rank = {j} THEN x.value END) AS x{j}" for j in range(1, k + 1))
    return (
        f"dk AS (SELECT target, max(rank) AS k FROM {peers} GROUP BY target), "
        f"dz AS (SELECT y.tag AS target, y.ts, any_value(y.value) AS y, any_value(dk.k) AS k, {xs} FROM {src} y JOIN dk ON dk.target = y.tag JOIN {peers} pr ON pr.target = y.tag "
        f"LEFT JOIN {src} x ON x.tag = pr.peer AND x.ts = y.ts GROUP BY y.tag, y.ts)"
    )


def whole(k: int) -> str:
    """A row of ``dz`` with every reading it needs."""
    return "y IS NOT NULL AND " + " AND ".join(f"(k < {j} OR x{j} IS NOT NULL)" for j in range(1, k + 1))


def solved(src: str, k: int, alpha: float, intercept: float, out: str = "wt", centred: bool = False) -> str:
    """CTE ``out``: target, train_rows, w0.. of the least squares of y on x1.., by elimination on the normal equations.

    Each step of the elimination is one CTE. Peers that a target lacks have weight 0. ``alpha`` is added to the diagonal, ``intercept``
    to that of the constant. With ``centred`` (no penalty on the constant) sums are about the means.
    """
    xs = [f"coalesce(x{j}, 0.0)" for j in range(1, k + 1)]
    if centred:
        means = ", ".join(f"avg({x}) OVER (PARTITION BY target) AS m{j}" for j, x in enumerate(xs, 1))
        parts = [f"{out}_c AS (SELECT target, k, y - avg(y) OVER (PARTITION BY target) AS yc, avg(y) OVER (PARTITION BY target) AS my, {means}, " + ", ".join(f"{x} AS x{j}" for j, x in enumerate(xs, 1)) + f" FROM {src})"]
        z, rhs, first, src = {j: f"(x{j} - m{j})" for j in range(1, k + 1)}, "yc", 1, f"{out}_c"
        keep = ", any_value(my) AS my, " + ", ".join(f"any_value(m{j}) AS m{j}" for j in range(1, k + 1))
    else:
        parts, z, rhs, first, keep = [], {0: "1.0"} | {j: x for j, x in enumerate(xs, 1)}, "y", 0, ""
    ids = range(first, k + 1)
    held = "".join(f", m{j}" for j in range(1, k + 1)) + ", my" if centred else ""

    def cell(i: int, j: int) -> str:
        if i != j:
            return f"sum({z[i]} * {z[j]})"
        own = intercept if i == 0 else alpha
        # a missing peer's row is the unit row
        return f"sum({z[i]} * {z[j]}) + {own}" + (f" + CASE WHEN max(k) < {i} THEN 1.0 ELSE 0.0 END" if i else "")

    cells = ", ".join(f"{cell(i, j)} AS a{i}_{j}" for i in ids for j in ids)
    parts.append(f"{out}_{first} AS (SELECT target, count(*) AS n, {cells}, " + ", ".join(f"sum({z[i]} * {rhs}) AS b{i}" for i in ids) + f"{keep} FROM {src} GROUP BY target)")
    for p in ids:
        out_cells = []
        for i in ids:
            factor = f"a{i}_{p} / a{p}_{p}"
            for j in ids:
                out_cells.append(f"a{i}_{j}" if i == p else f"a{i}_{j} - {factor} * a{p}_{j}")
                out_cells[-1] += f" AS a{i}_{j}"
            out_cells.append((f"b{i}" if i == p else f"b{i} - {factor} * b{p}") + f" AS b{i}")
        parts.append(f"{out}_{p + 1} AS (SELECT target, n{held}, {', '.join(out_cells)} FROM {out}_{p})")
    weights = ", ".join(f"b{i} / a{i}_{i} AS w{i}" for i in ids)
    if not centred:
        parts.append(f"{out} AS (SELECT target, n AS train_rows, {weights} FROM {out}_{k + 1})")
    else:
        parts.append(f"{out}_w AS (SELECT target, n, my{''.join(f', m{j}' for j in range(1, k + 1))}, {weights} FROM {out}_{k + 1})")
        back = " - ".join(["my", *[f"w{j} * m{j}" for j in range(1, k + 1)]])
        parts.append(f"{out} AS (SELECT target, n AS train_rows, {back} AS w0, " + ", ".join(f"w{j}" for j in range(1, k + 1)) + f" FROM {out}_w)")
    return ", ".join(parts)


def predicted(k: int) -> str:
    """The fit of a row of ``dz`` joined with weights; null where a reading it needs is missing."""
    return " + ".join(["w0", *[f"CASE WHEN k < {j} THEN 0.0 ELSE w{j} * x{j} END" for j in range(1, k + 1)]])


def peers_by_corr(corr: str, least: float, most: int = 5) -> str:
    """CTE ``pe``: target, peer, rank, r of the best pairs."""
    return (
        f"pc0 AS ({corr}), pc1 AS (SELECT tag_a AS target, tag_b AS peer, r FROM pc0 UNION ALL SELECT tag_b, tag_a, r FROM pc0), "
        "pc2 AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(abs(r), 10) DESC, peer) AS rank, max(round(abs(r), 10)) OVER (PARTITION BY target) AS best FROM pc1), "
        f"pe AS (SELECT target, peer, rank, r FROM pc2 WHERE rank <= {most} AND (round(abs(r), 10) >= {least} OR best < {least}))"
    )


def ridge_signal(src: str, corr: str, least: float, k_global: float, z: str = "sg", k: int = 5) -> str:
    """CTE ``s5``: tag, ts, predicted, z_peer of the ridge on correlated peers, trained on calm rows (``z`` holds z_global)."""
    return (
        f"{peers_by_corr(corr, least, k)}, {design(src, 'pe', k)}, "
        f"d1 AS (SELECT dz.*, {whole(k)} AS whole, coalesce(abs({z}.z_global), 0.0) < {k_global} AS calm FROM dz LEFT JOIN {z} ON {z}.tag = dz.target AND {z}.ts = dz.ts), "
        "d2 AS (SELECT target, count_if(whole) AS nw, count_if(whole AND calm) AS nc, max(k) AS kk FROM d1 GROUP BY target), "
        "d3 AS (SELECT d1.*, whole AND nw >= 30 AND (calm OR nc < greatest(30, 5 * kk)) AS train FROM d1 JOIN d2 USING (target)), "
        f"d4 AS (SELECT * FROM d3 WHERE train), {solved('d4', k, 1.0, 1.0)}, "
        f"d5 AS (SELECT d3.target AS tag, ts, y, train, {predicted(k)} AS predicted FROM d3 JOIN wt USING (target)), "
        "d6 AS (SELECT tag, greatest(1.4826 * mad(y - predicted), 1e-9) AS rs FROM d5 WHERE train GROUP BY tag), "
        "s5 AS (SELECT tag, ts, predicted, CASE WHEN rs > 1e-9 THEN (y - predicted) / rs END AS z_peer FROM d5 JOIN d6 USING (tag))"
    )
