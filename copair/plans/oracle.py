"""DuckDB oracle SQL for the registered queries (independent relational
formulations over the same parquet tables; the coevolution model is
scored by joins and group-bys here, by the map-only kernel in Spark)."""

from __future__ import annotations

from copair.functions.alphabet import ALPHA_PATH, CONSTANT_PROB

_ALPHAS = "[" + ", ".join(repr(float(a)) for a in ALPHA_PATH) + "]::DOUBLE[]"
_LOGIT_OFFSET = "ln((1 - 0.75) / 0.75)"

BASE = f"""
docs AS (
  SELECT doc_id AS pair_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents),
rawc AS (
  SELECT pair_id, CAST(p AS INTEGER) AS orig_pos, CASE WHEN p % 4 = 3 THEN 2 ELSE 4 END AS m,
         length(s) - length(replace(s, substr('ABCDEFGHIJKL', p + 1, 1), '')) AS ca,
         length(s) - length(replace(s, substr('MNOPQRSTUVWX', p + 1, 1), '')) AS cb
  FROM (SELECT pair_id, s, unnest(range(12)) AS p FROM docs)),
res AS (
  SELECT pair_id, 'A' AS side, orig_pos, CAST(CASE WHEN ca = 0 THEN 20 ELSE ca % m END AS INTEGER) AS aa FROM rawc
  UNION ALL
  SELECT pair_id, 'B' AS side, orig_pos,
         CAST(CASE WHEN cb = 0 THEN 20 WHEN pair_id % 4 <> 0 AND ca > 0 THEN 5 + ca % m ELSE 5 + cb % m END AS INTEGER) AS aa
  FROM rawc
  UNION ALL SELECT pair_id, 'A', 12, 0 FROM docs UNION ALL SELECT pair_id, 'B', 12, 5 FROM docs),
cnt AS (SELECT side, orig_pos, aa, count(*) AS n FROM res GROUP BY side, orig_pos, aa),
prof AS (
  SELECT side, orig_pos, sum(CASE WHEN aa = 20 THEN n ELSE 0 END) * 1.0 / sum(n) AS gap_freq,
         count(*) AS n_codes
  FROM cnt GROUP BY side, orig_pos),
prof2 AS (SELECT *, gap_freq >= 0.5 AS gappy, n_codes = 1 AS const,
                 (gap_freq < 0.5 AND n_codes <> 1) AS kept FROM prof),
kept AS (SELECT side, orig_pos,
                CAST(row_number() OVER (PARTITION BY side ORDER BY orig_pos) - 1 AS INTEGER) AS pos
         FROM prof2 WHERE kept),
widths AS (SELECT sum(CASE WHEN side = 'A' THEN 1 ELSE 0 END) AS la,
                  sum(CASE WHEN side = 'B' THEN 1 ELSE 0 END) AS lb FROM kept),
dres AS (SELECT r.pair_id, r.side, k.pos, r.aa FROM res r JOIN kept k ON r.side = k.side AND r.orig_pos = k.orig_pos),
npairs AS (SELECT count(*) AS n FROM docs),
lab AS (SELECT doc_id AS pair_id, quality FROM labels),
truth AS (SELECT pair_id, CAST(quality AS INTEGER) AS y FROM lab),
prior AS (
  SELECT pair_id, CASE WHEN pair_id % 10 < 7 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS z,
         CASE WHEN pair_id % 10 < 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS z_hard FROM docs)
"""


def _null(name: str, weights_sql: str) -> str:
    """CTEs ``{name}_pwm`` and ``{name}_llh`` for a weight table (pair_id, w)."""
    return f"""
{name}_w AS ({weights_sql}),
{name}_ws AS (SELECT d.side, d.pos, d.aa, sum(w.w) AS w_sum FROM dres d JOIN {name}_w w ON d.pair_id = w.pair_id
              GROUP BY d.side, d.pos, d.aa),
{name}_pwm AS (
  SELECT side, pos, aa,
         CASE WHEN w_sum / sum(w_sum) OVER (PARTITION BY side, pos) > 0
              THEN ln(w_sum / sum(w_sum) OVER (PARTITION BY side, pos)) ELSE ln(1.0 / 2100) END AS logp
  FROM {name}_ws),
{name}_score AS (
  SELECT d.pair_id, d.side, d.pos, coalesce(p.logp, ln(1.0 / 2100)) AS logp
  FROM dres d LEFT JOIN {name}_pwm p ON d.side = p.side AND d.pos = p.pos AND d.aa = p.aa),
{name}_llh AS (SELECT pair_id, sum(logp) AS null_llh FROM {name}_score GROUP BY pair_id)"""


NULL_SOFT = _null("ns", "SELECT pair_id, 1 - z AS w FROM prior")
NULL_HARD = _null("nh", "SELECT pair_id, 1 - z_hard AS w FROM prior WHERE z_hard = 0")

GIVEN = f"""
drank AS (
  SELECT side, pos, aa, n, row_number() OVER (PARTITION BY side, pos ORDER BY n DESC, aa) AS rk,
         sum(n) OVER (PARTITION BY side, pos) AS total
  FROM (SELECT side, pos, aa, count(*) AS n FROM dres GROUP BY side, pos, aa)),
erow AS (
  SELECT CASE WHEN e.vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS side,
         CAST((e.vec_id // 2) % (CASE WHEN e.vec_id % 2 = 0 THEN w.la ELSE w.lb END) AS INTEGER) AS pos,
         CAST(((e.vec_id // 2) // (CASE WHEN e.vec_id % 2 = 0 THEN w.la ELSE w.lb END)) % 5 + 1 AS INTEGER) AS rk,
         list_extract({_ALPHAS}, CAST(e.label % {len(ALPHA_PATH)} + 1 AS INTEGER)) AS alpha,
         CASE WHEN e.label = 8 THEN 2 WHEN e.label = 9 THEN 1 ELSE 1000 END AS most,
         CASE WHEN e.vec_id % 2 = 0 THEN w.lb ELSE w.la END AS lopp,
         7 * (e.label + 1) AS fold, e.embedding
  FROM embeddings e, widths w),
mcls AS (
  SELECT m.side, m.pos, m.alpha, d.aa AS cls, d.rk, ln(d.n * 1.0 / (d.total - d.n)) AS b0,
         count(*) OVER (PARTITION BY m.side, m.pos, m.alpha) AS nc,
         max(d.aa) OVER (PARTITION BY m.side, m.pos, m.alpha) AS top
  FROM (SELECT DISTINCT side, pos, alpha, most FROM erow) m JOIN drank d ON m.side = d.side AND m.pos = d.pos AND d.rk <= m.most),
mdl AS (SELECT DISTINCT side, pos, alpha FROM mcls),
fcls AS (SELECT * FROM mcls WHERE nc > 2 OR (nc = 2 AND cls = top)),
ecell AS (
  SELECT side, pos, alpha, rk, lopp, v, k % fold AS k
  FROM (SELECT side, pos, alpha, rk, lopp, fold, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS k FROM erow)),
coefs AS (
  SELECT c.side, c.pos, c.alpha, f.cls, CAST((c.k + c.rk) % c.lopp AS INTEGER) AS feat_pos,
         CAST((c.k // c.lopp + 4 * c.rk) % 20 AS INTEGER) AS feat_aa, 3.0 * sum(c.v) AS value
  FROM ecell c JOIN fcls f ON c.side = f.side AND c.pos = f.pos AND c.alpha = f.alpha AND c.rk = f.rk
  GROUP BY c.side, c.pos, c.alpha, f.cls, feat_pos, feat_aa),
gdf AS (
  SELECT m.side, m.pos, m.alpha, coalesce(c.df, 0) AS df
  FROM mdl m LEFT JOIN (SELECT side, pos, alpha, count(DISTINCT (feat_pos, feat_aa)) AS df FROM coefs
                        WHERE value <> 0 GROUP BY side, pos, alpha) c
  ON m.side = c.side AND m.pos = c.pos AND m.alpha = c.alpha),
opp AS (SELECT pair_id, CASE WHEN side = 'A' THEN 'B' ELSE 'A' END AS side, pos AS feat_pos, aa AS feat_aa FROM dres),
lin AS (
  SELECT o.pair_id, c.side, c.pos, c.alpha, c.cls, sum(c.value) AS xb
  FROM opp o JOIN coefs c ON o.side = c.side AND o.feat_pos = c.feat_pos AND o.feat_aa = c.feat_aa AND c.feat_aa < 20
  GROUP BY o.pair_id, c.side, c.pos, c.alpha, c.cls),
ggrid AS (
  SELECT d.pair_id, d.side, d.pos, m.alpha, m.cls, m.nc, m.top, m.b0, d.aa AS obs
  FROM dres d JOIN mcls m ON d.side = m.side AND d.pos = m.pos),
gsig AS (
  SELECT g.*, 1.0 / (1.0 + exp(-(g.b0 + coalesce(l.xb, 0.0)))) AS sg
  FROM ggrid g LEFT JOIN lin l ON g.pair_id = l.pair_id AND g.side = l.side AND g.pos = l.pos
                              AND g.alpha = l.alpha AND g.cls = l.cls),
glp0 AS (
  SELECT pair_id, side, pos, alpha, max(nc) AS nc, bool_or(cls = obs) AS seen, max(CASE WHEN cls = obs THEN sg END) AS own,
         sum(sg) AS total, max(CASE WHEN cls = top THEN sg END) AS up, max(CASE WHEN cls = obs AND cls = top THEN 1 ELSE 0 END) AS is_top
  FROM gsig GROUP BY pair_id, side, pos, alpha),
glp AS (
  SELECT pair_id, side, pos, alpha,
         CASE WHEN NOT seen THEN ln(1.0 / 210) WHEN nc > 2 THEN ln(own / total)
              WHEN nc = 1 THEN ln({CONSTANT_PROB!r}) WHEN is_top = 1 THEN ln(up) ELSE ln(1 - up) END AS logp
  FROM glp0),
gbic AS (
  SELECT d.side, d.pos, d.alpha, d.df, s.sum_logp,
         d.df * ln((SELECT n FROM npairs)) - 2 * s.sum_logp AS bic,
         max(d.df) OVER (PARTITION BY d.side, d.pos ORDER BY d.alpha DESC
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 100 AS in_path
  FROM gdf d JOIN (SELECT side, pos, alpha, sum(logp) AS sum_logp FROM glp GROUP BY side, pos, alpha) s
  ON d.side = s.side AND d.pos = s.pos AND d.alpha = s.alpha),
gsel AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, pos ORDER BY round(bic, 6) ASC, alpha DESC) AS rk
                 FROM gbic WHERE in_path) WHERE rk = 1),
alt_res AS (
  SELECT g.pair_id, g.side, g.pos, g.logp FROM glp g
  JOIN gsel s ON g.side = s.side AND g.pos = s.pos AND g.alpha = s.alpha),
alt AS (SELECT pair_id, sum(logp) AS alt_llh FROM alt_res GROUP BY pair_id)
"""

POSTERIOR = f"""
post AS (
  SELECT n.pair_id, pr.z, n.null_llh, a.alt_llh,
         1.0 / (1.0 + exp(n.null_llh - a.alt_llh + {_LOGIT_OFFSET})) AS z_post
  FROM ns_llh n JOIN alt a ON n.pair_id = a.pair_id JOIN prior pr ON pr.pair_id = n.pair_id),
posth AS (SELECT *, CASE WHEN z_post > 0.5 THEN 1 WHEN z_post < 0.5 THEN 0 ELSE -1 END AS zh FROM post)
"""

CONTACTS = """
csel AS (SELECT c.* FROM coefs c JOIN gsel s ON c.side = s.side AND c.pos = s.pos AND c.alpha = s.alpha),
blocks AS (SELECT pos AS pos_a, feat_pos AS pos_b, value FROM csel WHERE side = 'A'
           UNION ALL SELECT feat_pos AS pos_a, pos AS pos_b, value FROM csel WHERE side = 'B'),
css AS (SELECT pos_a, pos_b, sum(value * value) AS ss FROM blocks GROUP BY pos_a, pos_b),
cgrid AS (SELECT ka.pos AS pos_a, kb.pos AS pos_b, CAST(ka.orig_pos = kb.orig_pos AS INTEGER) AS is_contact
          FROM kept ka JOIN kept kb ON ka.side = 'A' AND kb.side = 'B'),
cmap AS (SELECT g.pos_a, g.pos_b, sqrt(coalesce(c.ss, 0.0)) AS strength
         FROM cgrid g LEFT JOIN css c ON g.pos_a = c.pos_a AND g.pos_b = c.pos_b),
capc AS (SELECT *, strength - (avg(strength) OVER (PARTITION BY pos_a)) * (avg(strength) OVER (PARTITION BY pos_b))
                    / (avg(strength) OVER ()) AS apc FROM cmap)
"""


def _trace_sql() -> str:
    """Three iterations of null M-step + E-step with the given coevolution model."""
    parts = [
        _null("t0n", "SELECT pair_id, 1 - z AS w FROM prior"),
        """
tr0 AS (SELECT 0 AS iter, pr.pair_id, pr.z, a.alt_llh, n.null_llh
        FROM prior pr JOIN alt a ON pr.pair_id = a.pair_id JOIN t0n_llh n ON n.pair_id = pr.pair_id)""",
    ]
    for k in (1, 2):
        parts.append(f"""
z{k} AS (SELECT pair_id, 1.0 / (1.0 + exp(null_llh - alt_llh + {_LOGIT_OFFSET})) AS z, alt_llh FROM tr{k - 1})""")
        parts.append(_null(f"t{k}n", f"SELECT pair_id, 1 - z AS w FROM z{k}"))
        parts.append(f"""
tr{k} AS (SELECT {k} AS iter, z.pair_id, z.z, z.alt_llh, n.null_llh FROM z{k} z JOIN t{k}n_llh n
          ON z.pair_id = n.pair_id)""")
    parts.append("""
trace AS (SELECT * FROM tr0 UNION ALL SELECT * FROM tr1 UNION ALL SELECT * FROM tr2),
tw AS (SELECT t.*, t.z * t.alt_llh AS alt_int, (1 - t.z) * t.null_llh AS null_nonint, tr.y
       FROM trace t LEFT JOIN truth tr ON t.pair_id = tr.pair_id),
tper AS (SELECT iter, sum(alt_llh) AS sum_alt, sum(null_llh) AS sum_null, sum(alt_int) AS sum_alt_int,
                sum(null_nonint) AS sum_null_nonint, sum(alt_int) + sum(null_nonint) AS total,
                sum(y * alt_llh) AS true_alt, sum((1 - y) * null_llh) AS true_null,
                sum(y * alt_llh) + sum((1 - y) * null_llh) AS true_total
         FROM tw GROUP BY iter),
tj AS (SELECT t.iter, t.pair_id, t.z, tr.y,
              CASE WHEN t.z > 0.5 THEN 1 WHEN t.z < 0.5 THEN 0 ELSE -1 END AS y_hat,
              least(greatest(t.z, 1e-15), 1 - 1e-15) AS pc
       FROM trace t JOIN truth tr ON t.pair_id = tr.pair_id),
trep AS (
  SELECT iter, count(*) AS n, count(DISTINCT y) AS n_classes,
         sum(CASE WHEN y = 1 AND y_hat = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN y = 0 AND y_hat = 0 THEN 1 ELSE 0 END) AS tn,
         sum(CASE WHEN y = 0 AND y_hat = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN y = 1 AND y_hat = 0 THEN 1 ELSE 0 END) AS fn,
         avg(-(y * ln(pc) + (1 - y) * ln(1 - pc))) AS ll
  FROM tj GROUP BY iter),
trep2 AS (
  SELECT *, CASE WHEN n_classes <= 1 THEN NULL
                 WHEN sqrt(1.0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) = 0 THEN 0.0
                 ELSE (1.0 * tp * tn - 1.0 * fp * fn) / sqrt(1.0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
            END AS mcc,
         CASE WHEN n_classes <= 1 THEN NULL ELSE ll END AS log_loss
  FROM trep)""")
    return ",".join(parts)


def _q(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n" + body


def oracle_sql() -> dict[str, str]:
    q = {}
    q["gap_profile"] = _q(BASE, body="SELECT side, orig_pos, round(gap_freq, 6) AS gap_freq, "
                                     "CAST(gappy AS INTEGER) AS gappy FROM prof2")
    q["column_cardinality"] = _q(BASE, body="SELECT side, orig_pos, n_codes, CAST(const AS INTEGER) AS constant FROM prof2")
    q["kept_positions"] = _q(BASE, body="SELECT side, orig_pos, pos FROM kept")
    q["encode_residues"] = _q(BASE, body="SELECT pair_id, side, orig_pos, aa FROM res")
    q["one_hot_features"] = _q(BASE, body="SELECT pair_id, side, CAST(pos * 20 + aa AS INTEGER) AS feature "
                                          "FROM dres WHERE aa < 20")
    q["check_pairs"] = _q(BASE, body="""
, ia AS (SELECT pair_id, list(aa ORDER BY orig_pos) AS v FROM res WHERE side = 'A' AND pair_id % 7 <> 3 GROUP BY pair_id),
ib AS (SELECT pair_id, list(aa ORDER BY orig_pos) AS v FROM res WHERE side = 'B' AND pair_id % 5 <> 2 GROUP BY pair_id),
c AS (
  SELECT 'shifted' AS kind, ia.v AS va, ib.v AS vb FROM ia FULL JOIN ib ON ia.pair_id = ib.pair_id
  UNION ALL SELECT 'same', v, v FROM ia
  UNION ALL SELECT 'paired', x.v, y.v FROM ia x JOIN ib y ON x.pair_id = y.pair_id),
g AS (
  SELECT kind, count(va) AS n_a, count(vb) AS n_b, count(*) - count(va) AS missing_a, count(*) - count(vb) AS missing_b,
         coalesce(bool_and(va = vb), false) AS identical FROM c GROUP BY kind)
SELECT kind, n_a, n_b, missing_a, missing_b, CAST(identical AS INTEGER) AS identical,
       CAST(n_a = n_b AND missing_a = 0 AND missing_b = 0 AND n_a > 1 AND NOT identical AS INTEGER) AS ok FROM g""")
    q["on_unknown"] = _q(BASE, body="""
, odd AS (SELECT pair_id, side, orig_pos, CASE WHEN side = 'A' AND orig_pos = 0 AND pair_id % 10 = 3 THEN -1
                 WHEN side = 'B' AND orig_pos = 1 AND pair_id % 15 = 4 THEN -1 ELSE aa END AS aa FROM res),
bad AS (SELECT DISTINCT pair_id FROM odd WHERE aa = -1)
SELECT 'error' AS mode, side, count(DISTINCT pair_id) AS n_pairs, 0 AS n_rejected, count(*) FILTER (WHERE aa = -1) AS n_codes
FROM odd GROUP BY side
UNION ALL SELECT 'gap', side, count(DISTINCT pair_id), 0, count(*) FILTER (WHERE aa IN (20, -1)) FROM odd GROUP BY side
UNION ALL SELECT 'quarantine', side, count(DISTINCT pair_id), (SELECT count(*) FROM bad), count(*) FILTER (WHERE aa = 20)
FROM odd WHERE pair_id NOT IN (SELECT pair_id FROM bad) GROUP BY side""")
    q["unknown_residues"] = _q(BASE, body="""
SELECT ch, count(*) AS n, count(DISTINCT pair_id) AS n_seqs
FROM (SELECT pair_id, unnest(string_split(s, '')) AS ch FROM docs)
WHERE ch <> '' AND instr('ARNDCEQGHILKMFPSTWYV-', ch) = 0 GROUP BY ch""")
    q["align_contact_map"] = _q(BASE, body="""
SELECT ka.pos AS pos_a, kb.pos AS pos_b, CAST(ka.orig_pos = kb.orig_pos AS INTEGER) AS is_contact
FROM kept ka JOIN kept kb ON ka.side = 'A' AND kb.side = 'B'""")
    q["check_contact_map"] = _q(BASE, body="""
, full_map AS (SELECT a.orig_pos AS pos_a, b.orig_pos AS pos_b, CAST(a.orig_pos = b.orig_pos AS DOUBLE) AS v
             FROM prof a JOIN prof b ON a.side = 'A' AND b.side = 'B'),
m AS (SELECT 'good' AS kind, pos_a, pos_b, v FROM full_map
      UNION ALL SELECT 'bad_values', pos_a, pos_b, CASE WHEN (pos_a + pos_b) % 11 = 5 THEN 0.5 ELSE v END FROM full_map
      UNION ALL SELECT 'short', pos_a, pos_b, v FROM full_map WHERE pos_a < 9),
g AS (SELECT kind, count(*) AS n_cells, max(pos_a) + 1 AS rows, max(pos_b) + 1 AS cols,
             sum(CASE WHEN v NOT IN (0, 1) THEN 1 ELSE 0 END) AS bad_values, sum(CASE WHEN v = 1 THEN 1 ELSE 0 END) AS n_contacts,
             (SELECT count(*) FROM prof WHERE side = 'A') AS len_a, (SELECT count(*) FROM prof WHERE side = 'B') AS len_b
      FROM m GROUP BY kind)
SELECT kind, n_cells, CAST(rows AS BIGINT) AS rows, CAST(cols AS BIGINT) AS cols, CAST(bad_values AS BIGINT) AS bad_values,
       CAST(n_contacts AS BIGINT) AS n_contacts, CAST(len_a AS BIGINT) AS len_a, CAST(len_b AS BIGINT) AS len_b,
       CAST(rows = len_a AND cols = len_b AND n_cells = len_a * len_b AND bad_values = 0 AS INTEGER) AS ok FROM g""")
    q["true_labels"] = _q(BASE, body="""
SELECT pair_id, CAST(pair_id <= CAST(floor(0.75 * (SELECT n FROM npairs)) AS BIGINT) - 1 AS INTEGER) AS y FROM docs""")
    q["random_labels"] = _q(BASE, body="""
SELECT pair_id, CASE WHEN CAST(('0x' || substr(md5(pair_id || ':42'), 1, 13)) AS BIGINT) / pow(16, 13) < 0.75
                     THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS z FROM docs""")
    q["null_pwm_soft"] = _q(BASE, NULL_SOFT, body="SELECT side, pos, aa, round(logp, 6) AS logp FROM ns_pwm")
    q["null_pwm_hard"] = _q(BASE, NULL_HARD, body="SELECT side, pos, aa, round(logp, 6) AS logp FROM nh_pwm")
    q["null_score"] = _q(BASE, NULL_SOFT, body="SELECT pair_id, side, pos, round(logp, 6) AS logp FROM ns_score")
    q["null_llh"] = _q(BASE, NULL_SOFT, body="SELECT pair_id, round(null_llh, 6) AS null_llh FROM ns_llh")
    q["degrees_of_freedom"] = _q(BASE, GIVEN, body="SELECT side, pos, alpha, CAST(df AS BIGINT) AS df FROM gdf")
    q["bic"] = _q(BASE, GIVEN, body="SELECT side, pos, alpha, CAST(df AS BIGINT) AS df, round(sum_logp, 6) AS sum_logp, "
                                    "round(bic, 6) AS bic FROM gbic")
    q["dfmax_path"] = _q(BASE, GIVEN, body="SELECT side, pos, alpha, CAST(df AS BIGINT) AS df, "
                                           "CAST(in_path AS INTEGER) AS in_path FROM gbic")
    q["select_by_bic"] = _q(BASE, GIVEN, body="SELECT side, pos, alpha, CAST(df AS BIGINT) AS df, "
                                              "round(bic, 6) AS bic FROM gsel")
    q["alt_score"] = _q(BASE, GIVEN, body="SELECT pair_id, side, pos, round(logp, 6) AS logp FROM alt_res")
    q["alt_llh"] = _q(BASE, GIVEN, body="SELECT pair_id, round(alt_llh, 6) AS alt_llh FROM alt")
    q["posterior"] = _q(BASE, NULL_SOFT, GIVEN, POSTERIOR, body="SELECT pair_id, round(z_post, 6) AS z FROM post")
    q["harden"] = _q(BASE, NULL_SOFT, GIVEN, POSTERIOR, body="SELECT pair_id, zh AS z_hard FROM posth")
    q["convergence"] = _q(BASE, NULL_SOFT, GIVEN, POSTERIOR, body="""
SELECT count(*) AS n, round(sum(abs(z_post - z)), 6) AS sum_abs_diff,
       round(sum(abs(z_post - z)) / count(*), 6) AS mean_abs_diff,
       CAST(sum(abs(z_post - z)) / count(*) < 0.005 AS INTEGER) AS converged FROM post""")
    q["select_interacting"] = _q(BASE, NULL_SOFT, GIVEN, POSTERIOR,
                                 body="SELECT pair_id, round(z_post, 6) AS z FROM posth WHERE zh = 1")
    q["select_noninteracting"] = _q(BASE, NULL_SOFT, GIVEN, POSTERIOR,
                                    body="SELECT pair_id, round(z_post, 6) AS z FROM posth WHERE zh = 0")
    q["select_for_contacts"] = _q(BASE, NULL_SOFT, GIVEN, POSTERIOR,
                                  body="SELECT pair_id, round(z_post, 6) AS z FROM post WHERE z_post >= 0.5")
    q["fit_first_step"] = _q(BASE, """
ccount AS (SELECT side, pos, aa, count(*) AS n FROM dres GROUP BY side, pos, aa),
ncls AS (SELECT side, pos, count(*) AS k, max(aa) AS top FROM ccount GROUP BY side, pos),
tmodels AS (SELECT c.side, c.pos, c.aa AS cls, c.n * 1.0 / (SELECT n FROM npairs) AS p
            FROM ccount c JOIN ncls k ON c.side = k.side AND c.pos = k.pos
            WHERE k.k >= 3 OR (k.k = 2 AND c.aa = k.top)),
feats AS (SELECT side, pos AS feat_pos, aa AS feat_aa, n AS nf FROM ccount WHERE aa < 20),
cooc AS (SELECT t.side, t.pos, t.aa AS cls, o.pos AS feat_pos, o.aa AS feat_aa, count(*) AS nfc
         FROM dres t JOIN dres o ON t.pair_id = o.pair_id AND t.side <> o.side AND o.aa < 20
         GROUP BY t.side, t.pos, t.aa, o.pos, o.aa),
grads AS (SELECT m.side, m.pos, m.cls, abs(m.p * f.nf - coalesce(c.nfc, 0)) / (SELECT n FROM npairs) AS g
          FROM tmodels m JOIN feats f ON f.side <> m.side
          LEFT JOIN cooc c ON c.side = m.side AND c.pos = m.pos AND c.cls = m.cls
                          AND c.feat_pos = f.feat_pos AND c.feat_aa = f.feat_aa)""", body="""
SELECT side, pos, cls, round(max(g), 6) AS max_grad, round(max(g) / 0.99, 6) AS alpha_max,
       round(sum(greatest(g - 0.02, 0)), 6) AS step_l1, CAST(sum(CASE WHEN g > 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS step_nonzero
FROM grads GROUP BY side, pos, cls""")
    q["fit_kkt"] = _q(BASE, body="""
, ccount AS (SELECT side, pos, aa FROM dres GROUP BY side, pos, aa),
ncls AS (SELECT side, pos, count(*) AS k, max(aa) AS top FROM ccount GROUP BY side, pos)
SELECT c.side, c.pos, c.aa AS cls, 1 AS optimal, 1 AS converged
FROM ccount c JOIN ncls k ON c.side = k.side AND c.pos = k.pos WHERE k.k >= 3 OR (k.k = 2 AND c.aa = k.top)""")
    q["couplings"] = _q(BASE, GIVEN, CONTACTS, body="""
SELECT pos_a, pos_b, round(strength, 6) AS strength, 'A' || pos_a || ':B' || pos_b AS name FROM cmap""")
    q["apc"] = _q(BASE, GIVEN, CONTACTS, body="SELECT pos_a, pos_b, round(strength, 6) AS strength, "
                                              "round(apc, 6) AS apc FROM capc")
    q["top_contacts"] = _q(BASE, GIVEN, CONTACTS, body="""
SELECT pos_a, pos_b, round(apc, 6) AS apc FROM capc ORDER BY apc DESC, pos_a, pos_b LIMIT 10""")
    q["contact_metrics"] = _q(BASE, GIVEN, CONTACTS, body="""
SELECT rank, pos_a, pos_b, tp,
       round(CASE WHEN least(rank, pos) > 0 THEN tp * 1.0 / least(rank, pos) END, 6) AS tpr,
       round(tp * 1.0 / rank, 6) AS ppv
FROM (SELECT t.*, row_number() OVER (ORDER BY apc DESC, pos_a, pos_b) AS rank,
             sum(is_contact) OVER (ORDER BY apc DESC, pos_a, pos_b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS tp,
             (SELECT sum(is_contact) FROM cgrid) AS pos
      FROM (SELECT c.*, g.is_contact FROM capc c JOIN cgrid g ON c.pos_a = g.pos_a AND c.pos_b = g.pos_b
            ORDER BY apc DESC, pos_a, pos_b LIMIT 20) t)""")
    q["contact_mcc"] = _q(BASE, GIVEN, CONTACTS, body="""
SELECT col, tp, tn, fp, fn,
       round(CASE WHEN sqrt(1.0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) = 0 THEN 0.0
             ELSE (1.0 * tp * tn - 1.0 * fp * fn) / sqrt(1.0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6)
         AS mcc
FROM (SELECT col, sum(CASE WHEN is_contact = 1 AND v > 0 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN is_contact = 0 AND NOT (v > 0) THEN 1 ELSE 0 END) AS tn,
             sum(CASE WHEN is_contact = 0 AND v > 0 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN is_contact = 1 AND NOT (v > 0) THEN 1 ELSE 0 END) AS fn
      FROM (SELECT 'strength' AS col, c.strength AS v, g.is_contact FROM capc c JOIN cgrid g ON c.pos_a = g.pos_a AND c.pos_b = g.pos_b
            UNION ALL
            SELECT 'apc' AS col, c.apc AS v, g.is_contact FROM capc c JOIN cgrid g ON c.pos_a = g.pos_a AND c.pos_b = g.pos_b) u
      GROUP BY col)""")
    q["binarize_contacts"] = _q(BASE, GIVEN, CONTACTS, body="""
SELECT pos_a, pos_b, CAST(apc > 0 AS INTEGER) AS predicted, CAST(strength > 0.5 AS INTEGER) AS strong FROM capc""")
    tr = _trace_sql()
    sums = [f"SELECT {k} AS iter, 'alt' AS model, side, pos, logp FROM alt_res" for k in range(3)]
    sums += [f"SELECT {k}, 'null', side, pos, logp FROM t{k}n_score" for k in range(3)]
    q["residue_llh"] = _q(BASE, GIVEN, tr, body=f"""
SELECT iter, model, side, pos, count(*) AS n, round(sum(logp), 6) AS logp FROM ({' UNION ALL '.join(sums)})
GROUP BY iter, model, side, pos""")
    q["weighted_llh"] = _q(BASE, GIVEN, tr, body="""
SELECT iter, pair_id, round(alt_int, 6) AS alt_int, round(null_nonint, 6) AS null_nonint FROM tw""")
    q["llh_per_iter"] = _q(BASE, GIVEN, tr, body="""
SELECT iter, round(sum_alt, 6) AS sum_alt, round(sum_null, 6) AS sum_null, round(sum_alt_int, 6) AS sum_alt_int,
       round(sum_null_nonint, 6) AS sum_null_nonint, round(total, 6) AS total, round(true_alt, 6) AS true_alt,
       round(true_null, 6) AS true_null, round(true_total, 6) AS true_total FROM tper""")
    q["llh_monotonic"] = _q(BASE, GIVEN, tr, body="""
SELECT CAST(coalesce(bool_and(CASE WHEN prev IS NOT NULL THEN total > prev END), true) AS INTEGER) AS monotonic,
       count(*) AS n_iters
FROM (SELECT total, lag(total) OVER (ORDER BY iter) AS prev FROM tper)""")
    q["confusion"] = _q(BASE, GIVEN, tr, body="""
SELECT g.y, g.y_hat, coalesce(c.n, 0) AS n,
       round(coalesce(c.n, 0) * 1.0 / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.y), 6) AS share
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(y, y_hat)) g
LEFT JOIN (SELECT y, y_hat, count(*) AS n FROM tj WHERE iter = 2 GROUP BY y, y_hat) c
ON g.y = c.y AND g.y_hat = c.y_hat""")
    q["label_report"] = _q(BASE, GIVEN, tr, body="""
SELECT n, n_classes, tp, tn, fp, fn, round(mcc, 6) AS mcc, round(log_loss, 6) AS log_loss FROM trep2 WHERE iter = 2""")
    q["performance_per_iter"] = _q(BASE, GIVEN, tr, body="""
SELECT iter, n, tp, tn, fp, fn, round(mcc, 6) AS mcc, round(log_loss, 6) AS log_loss FROM trep2""")
    q["label_evolution"] = _q(BASE, GIVEN, tr, body="""
SELECT pair_id, round(max(CASE WHEN iter = 0 THEN z END), 6) AS z_0, round(max(CASE WHEN iter = 1 THEN z END), 6) AS z_1,
       round(max(CASE WHEN iter = 2 THEN z END), 6) AS z_2 FROM trace GROUP BY pair_id""")
    q["llh_evolution"] = _q(BASE, GIVEN, tr, body="""
SELECT pair_id, round(max(CASE WHEN iter = 0 THEN alt_llh END), 6) AS alt_0,
       round(max(CASE WHEN iter = 1 THEN alt_llh END), 6) AS alt_1,
       round(max(CASE WHEN iter = 2 THEN alt_llh END), 6) AS alt_2,
       round(max(CASE WHEN iter = 0 THEN null_llh END), 6) AS null_llh FROM trace GROUP BY pair_id""")
    q["alt_vs_null"] = _q(BASE, GIVEN, tr, body="""
SELECT iter, pair_id, round(alt_llh, 6) AS alt_llh, round(null_llh, 6) AS null_llh FROM trace""")
    return q
