"""DuckDB text of the shared views, written independently of the Spark code."""

from __future__ import annotations

H24 = 86_400_000
RETENTION = 900_000


def tx(k: int) -> str:
    """Common table expressions e, sc, b, tx: the transaction view with its noise."""
    arms = [
        ("true", "s0 + CASE WHEN event_id % 7 = 0 THEN 255 ELSE 0 END", "''", 0),
        ("event_id % 50 = 0", "s0 + 1003", "''", 0),
        ("event_id % 97 = 0", "s0 + 1006", "'-x'", 0),
        ("event_id % 89 = 0", "s0 + 1007", "''", 1),
        ("event_id % 53 = 0", "s0 + 10 * (n * 5 // 100) + 1", "''", 0),
    ]
    union = " UNION ALL ".join(
        f"SELECT {seq} AS seq, event_id, user_id, 'evt-' || event_id || {suffix} AS eid, 'txn-' || event_id AS txn, "
        f"'cus-' || user_id AS cus, amt + {extra} AS amt, cur, ms, part, bucket FROM b WHERE {cond}"
        for cond, seq, suffix, extra in arms)
    return f"""
e AS (SELECT event_id, user_id, value, epoch_us(ts) AS us FROM events),
sc AS (SELECT min(us) // 1000 AS t0, count(*) AS n FROM e),
b AS (SELECT event_id, user_id, n, CAST(round(value * 100) AS BIGINT) AS amt,
        CASE WHEN event_id % 10 = 0 THEN 'USD' ELSE 'BRL' END AS cur,
        t0 + (us // 1000 - t0) // {k} AS ms, event_id % 12 AS part, user_id % 12 AS bucket,
        event_id * 10 AS s0 FROM e, sc),
tx AS ({union})"""


def identity(k: int) -> str:
    """Adds t1, t2 (with both stream times) and outc (seq, outcome)."""
    return tx(k) + f""",
t1 AS (SELECT *, max(ms) OVER (PARTITION BY part ORDER BY seq ROWS UNBOUNDED PRECEDING) AS st1 FROM tx),
k1 AS (SELECT *, row_number() OVER (PARTITION BY part, txn ORDER BY seq) AS rn FROM t1),
f1 AS (SELECT part, txn, rn, seq, st1 AS anchor, eid AS first_eid, false AS conflict FROM k1 WHERE rn = 1
  UNION ALL
  SELECT k1.part, k1.txn, k1.rn, k1.seq,
    CASE WHEN k1.st1 - f1.anchor >= {H24} THEN k1.st1 ELSE f1.anchor END,
    CASE WHEN k1.st1 - f1.anchor >= {H24} THEN k1.eid ELSE f1.first_eid END,
    k1.st1 - f1.anchor < {H24} AND k1.eid <> f1.first_eid
  FROM f1 JOIN k1 ON k1.part = f1.part AND k1.txn = f1.txn AND k1.rn = f1.rn + 1),
s2 AS (SELECT * FROM t1 WHERE seq NOT IN (SELECT seq FROM f1 WHERE conflict)),
t2 AS (SELECT *, max(ms) OVER (PARTITION BY bucket ORDER BY seq ROWS UNBOUNDED PRECEDING) AS st2 FROM s2),
k2 AS (SELECT *, row_number() OVER (PARTITION BY cus, eid ORDER BY seq) AS rn FROM t2),
f2 AS (SELECT cus, eid, rn, seq, st2 AS anchor, amt AS first_amt, 'accepted' AS outcome FROM k2 WHERE rn = 1
  UNION ALL
  SELECT k2.cus, k2.eid, k2.rn, k2.seq,
    CASE WHEN k2.st2 - f2.anchor >= {H24} THEN k2.st2 ELSE f2.anchor END,
    CASE WHEN k2.st2 - f2.anchor >= {H24} THEN k2.amt ELSE f2.first_amt END,
    CASE WHEN k2.st2 - f2.anchor >= {H24} THEN 'accepted' WHEN k2.amt = f2.first_amt THEN 'duplicate'
         ELSE 'EVENT_IDENTITY_CONFLICT' END
  FROM f2 JOIN k2 ON k2.cus = f2.cus AND k2.eid = f2.eid AND k2.rn = f2.rn + 1),
outc AS (SELECT seq, 'TRANSACTION_IDENTITY_CONFLICT' AS outcome FROM f1 WHERE conflict
  UNION ALL SELECT seq, outcome FROM f2)"""


def history(k: int) -> str:
    """Adds acc: accepted rows with avail, late, o60, o300, o600."""
    counts = ", ".join(
        f"1 + count(h.seq) FILTER (WHERE h.ms >= a.ms - {w * 1000}) AS o{w}" for w in (60, 300, 600))
    return identity(k) + f""",
a0 AS (SELECT t2.* FROM t2 JOIN outc USING (seq) WHERE outcome = 'accepted'),
acc AS (SELECT a.seq, a.event_id, a.eid, a.txn, a.cus, a.amt, a.cur, a.ms, a.st2,
    a.ms >= a.st2 - {RETENTION} AS avail, a.ms < a.st2 AS late, {counts}
  FROM a0 a LEFT JOIN a0 h ON h.cus = a.cus AND h.seq < a.seq AND h.ms <= a.ms
    AND h.ms >= greatest(a.ms - 600000, a.st2 - {RETENTION})
  GROUP BY a.seq, a.event_id, a.eid, a.txn, a.cus, a.amt, a.cur, a.ms, a.st2)"""


def iso(us: str) -> str:
    """ISO text of epoch microseconds with 0, 3 or 6 fraction digits."""
    return (f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ({us}) % 1000000 = 0 THEN '' WHEN ({us}) % 1000 = 0 "
            f"THEN '.' || lpad(CAST(({us}) % 1000000 // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(({us}) % 1000000 AS VARCHAR), 6, '0') END || 'Z'")


def record(fields: dict[str, str]) -> str:
    """JSON object from SQL expressions of its values' texts."""
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + " || '}'"


def quoted(value: str) -> str:
    return f"""'"' || {value} || '"'"""


def uuid3(namespace: str, value: str) -> str:
    d = f"md5('{namespace}:' || {value})"
    return (f"(substr({d},1,8) || '-' || substr({d},9,4) || '-3' || substr({d},14,3) || '-' || "
            f"translate(substr({d},17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr({d},18,3) || '-' || "
            f"substr({d},21,12))")


def results(k: int) -> str:
    """Adds ev (outcome per rule) and assessed."""
    return history(k) + f""",
ev0 AS (SELECT *, cur = 'BRL' AND amt >= 30000 AS r_amount,
    CASE WHEN avail THEN o600 >= 3 END AS r_burst,
    cur = 'BRL' AND amt >= 10000 AS both_1, CASE WHEN avail THEN o300 >= 2 END AS both_2,
    CASE WHEN avail THEN o60 >= 2 END AS either_1, cur = 'USD' AND amt >= 40000 AS either_2 FROM acc),
ev AS (SELECT *, both_1 AND both_2 AS r_both, either_1 OR either_2 AS r_either FROM ev0),
assessed AS (SELECT *,
    CASE WHEN r_amount OR coalesce(r_burst, false) OR coalesce(r_both, false) OR coalesce(r_either, false) THEN 'SUSPICIOUS'
         WHEN r_burst IS NULL OR r_both IS NULL OR r_either IS NULL THEN 'INCONCLUSIVE' ELSE 'NOT_SUSPICIOUS' END AS status,
    CASE WHEN r_burst THEN 'CRITICAL' WHEN r_amount THEN 'HIGH' WHEN r_both THEN 'MEDIUM' WHEN r_either THEN 'LOW'
         ELSE 'NONE' END AS severity, {uuid3('ASSESSMENT', 'eid')} AS assessment_id FROM ev)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


# Proposals and decisions over orders.
GOVERNANCE = """
p0 AS (SELECT 'head-' || (o_custkey % 25) AS head, 'rule-' || (o_custkey % 25) || '-' || (o_orderkey % 3) AS rule_id,
    'ver-' || o_orderkey AS vid,
    CASE WHEN o_orderkey % 29 = 7 THEN 'DELETE' WHEN o_orderstatus = 'F' THEN 'RETIRE' ELSE 'UPSERT' END AS ct,
    'user-' || (o_orderkey % 5) AS author, o_orderkey AS seq, o_orderkey % 17 = 5 AS broken,
    CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders),
p AS (SELECT *, CASE WHEN ct = 'DELETE' THEN 'INVALID_CHANGE_TYPE'
    WHEN ct = 'UPSERT' AND broken THEN 'UNSUPPORTED_RULE_NODE' END AS reject_reason FROM p0),
v AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY seq) AS num FROM p WHERE reject_reason IS NULL),
d0 AS (SELECT o_orderkey * 2 AS dseq, 'ver-' || o_orderkey AS vid,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'REJECT' ELSE 'APPROVE' END AS decision, 'user-' || (o_custkey % 5) AS approver
  FROM orders UNION ALL
  SELECT o_orderkey * 2 + 301, 'ver-' || o_orderkey, 'APPROVE', 'user-' || ((o_orderkey + 1) % 5) FROM orders),
d AS (SELECT d0.*, v.head, v.rule_id, v.ct, v.author, row_number() OVER (PARTITION BY v.head ORDER BY dseq) AS rn
  FROM d0 JOIN v USING (vid))"""


def decided(max_rules: int = 100) -> str:
    """Adds g: every decision with outcome, reason, version and the set after it, walked in order."""
    return GOVERNANCE + f""",
w(head, rn, active, ver, done, dseq, outcome, reason) AS (
  SELECT head, CAST(0 AS BIGINT), CAST([] AS STRUCT(r VARCHAR, v VARCHAR)[]), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]),
    CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT head FROM d)
  UNION ALL
  SELECT head, rn, CASE WHEN ok AND decision = 'APPROVE' THEN cand ELSE active END,
    ver + CASE WHEN ok AND decision = 'APPROVE' THEN 1 ELSE 0 END,
    CASE WHEN ok THEN list_append(done, vid) ELSE done END, dseq,
    CASE WHEN ok THEN 'SUCCESS' WHEN why = 'RULESET_SIZE_EXCEEDS_LIMIT' THEN 'REFUSED' ELSE 'DENIED' END, why
  FROM (SELECT *, why IS NULL AS ok FROM (SELECT *, CASE
      WHEN list_contains(done, vid) THEN 'VERSION_ALREADY_DECIDED'
      WHEN author = approver THEN CASE WHEN decision = 'APPROVE' THEN 'SELF_APPROVAL' ELSE 'SELF_REJECTION' END
      WHEN decision = 'APPROVE' AND len(cand) = 0 THEN 'ACTIVE_RULESET_MUST_NOT_BE_EMPTY'
      WHEN decision = 'APPROVE' AND len(cand) > {max_rules} THEN 'RULESET_SIZE_EXCEEDS_LIMIT' END AS why
    FROM (SELECT w.head, d.rn, w.active, w.ver, w.done, d.dseq, d.vid, d.decision, d.author, d.approver,
        list_concat(list_filter(w.active, lambda x: x.r <> d.rule_id),
          CASE WHEN d.ct = 'UPSERT' THEN [{{'r': d.rule_id, 'v': d.vid}}] ELSE [] END) AS cand
      FROM w JOIN d ON d.head = w.head AND d.rn = w.rn + 1)))),
g AS MATERIALIZED (SELECT d.*, w.outcome, w.reason, w.active, CASE WHEN w.outcome = 'SUCCESS' AND d.decision = 'APPROVE' THEN w.ver END AS ver
  FROM w JOIN d USING (head, rn))"""


# Snapshots over suppliers.
SNAPSHOTS = """
n0 AS (SELECT s_suppkey AS k, s_suppkey * 1000 + 5 AS seq, s_suppkey + (s_suppkey * 13) % 5 + 1 AS version,
    CASE WHEN s_suppkey % 23 = 9 THEN 'OTHER' ELSE 'ACTIVE' END AS key,
    CASE WHEN s_suppkey % 19 = 3 THEN 'INVALID_RULESET_SCHEMA' WHEN s_suppkey % 9 = 4 THEN 'INVALID_RULESET_HASH'
         WHEN s_suppkey % 11 = 5 THEN 'UNSUPPORTED_RULE_NODE' END AS reject_reason FROM supplier),
n1 AS (SELECT *, max(CASE WHEN key = 'ACTIVE' AND reject_reason IS NULL THEN version END)
    OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM n0),
n AS (SELECT *, CASE WHEN key <> 'ACTIVE' THEN 'ignored_key' WHEN reject_reason IS NOT NULL THEN 'rejected'
    WHEN version <= cur THEN 'not_newer' ELSE 'accepted' END AS disposition FROM n1)"""

# Delivery attempt logs over events, walked in order.
ATTEMPTS = """
l AS (SELECT 'req-' || (event_id // 8) AS rid, event_id AS seq_at,
    CASE WHEN event_type IN ('view','signup') THEN 'CLAIM' WHEN event_type = 'click' THEN 'SENT' ELSE 'FAILED' END AS kind,
    (event_id % 8) // 3 + 1 AS attempt, event_id % 8 AS pos FROM events),
q(rid, pos, status, n, seq_at, kind, result) AS (
  SELECT DISTINCT rid, CAST(-1 AS BIGINT), 'PENDING', CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM l
  UNION ALL
  SELECT l.rid, l.pos,
    CASE WHEN l.kind = 'CLAIM' AND status IN ('PENDING','FAILED') THEN 'SENDING'
         WHEN l.kind <> 'CLAIM' AND status = 'SENDING' AND l.attempt = n THEN l.kind ELSE status END,
    n + CASE WHEN l.kind = 'CLAIM' AND status IN ('PENDING','FAILED') THEN 1 ELSE 0 END, l.seq_at, l.kind,
    CASE WHEN l.kind = 'CLAIM' THEN CASE status WHEN 'SENT' THEN 'ALREADY_SENT' WHEN 'SENDING' THEN 'IN_PROGRESS' ELSE 'ACQUIRED' END
         WHEN status = 'SENDING' AND l.attempt = n THEN 'APPLIED' ELSE 'DELIVERY_NOT_SENDING' END
  FROM q JOIN l ON l.rid = q.rid AND l.pos = q.pos + 1),
lg AS (SELECT rid, max_by(status, pos) AS status, max(n) AS attempt_count FROM q GROUP BY rid)"""

# The delivery log: attempts with the fields of requests and outcomes, its effective rows, and one row per request.
DELIVERY = ATTEMPTS + """,
ev_ AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
fx AS (SELECT q.*, e.user_id, e.us, CASE WHEN q.kind = 'SENT' THEN 'prov-' || e.event_id END AS provider,
    CASE WHEN q.kind = 'FAILED' THEN CASE e.event_id % 2 WHEN 1 THEN 'CHANNEL_DELIVERY_FAILED' ELSE 'CONTACT_RESOLUTION_FAILED' END END AS why
  FROM q JOIN ev_ e ON e.event_id = q.seq_at WHERE pos >= 0),
ins AS (SELECT rid, min(seq_at) AS first_claim, min_by(us, seq_at) AS created_us FROM fx WHERE kind = 'CLAIM' GROUP BY rid),
took AS (SELECT rid, max_by(kind, seq_at) AS last_kind, max_by(us, seq_at) AS last_us, max_by(provider, seq_at) AS last_provider,
    arg_max(why, seq_at) FILTER (WHERE result = 'APPLIED') AS last_why, max(seq_at) FILTER (WHERE result = 'APPLIED') AS last_applied
  FROM fx WHERE result IN ('ACQUIRED', 'APPLIED') GROUP BY rid),
applied AS (SELECT rid, seq_at, kind, n, provider, why, us FROM fx WHERE result = 'APPLIED'),
told AS (SELECT * FROM applied UNION ALL
  SELECT a.rid, f.seq_at, a.kind, a.n, a.provider, a.why, a.us FROM fx f JOIN applied a ON a.rid = f.rid AND a.kind = 'SENT' WHERE f.result = 'ALREADY_SENT')"""
