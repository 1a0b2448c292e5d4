"""SQL over the given tables that must give the rows of the registered queries.

Each query is written as a chain of named parts; ``_sql`` puts those a statement needs in
front of it.
"""

from __future__ import annotations

from . import derive

WINDOW_START = "TIMESTAMP '2024-01-30 00:00:00'"
STAMP = "'%Y-%m-%dT%H:%M:%S.%fZ'"


def _text(name: str, value: str) -> str:
    return f"""coalesce('"{name}":"' || {value} || '"', '"{name}":null')"""


def _holds(name: str, source: str, key: str, at: str, ttl: str, owner: str) -> dict[str, str]:
    """Parts that fold rows of a key in time order: numbered rows, acquisitions, labels."""
    same = " AND ".join(f"n.{k} IS NOT DISTINCT FROM a.{k}" for k in key.split(", "))
    same_own = " AND ".join(f"own.{k} IS NOT DISTINCT FROM m.{k}" for k in key.split(", "))
    prefixed = ", ".join(f"n.{k}" for k in key.split(", "))
    return {
        f"{name}_rows": f"""
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at}, seq, delivery_no) AS rn FROM {source}""",
        f"{name}_anchors": f"""
            SELECT {key}, rn, {at} + {ttl} AS expires_at FROM {name}_rows WHERE rn = 1
            UNION ALL
            SELECT {key}, rn, expires_at FROM (
              SELECT {prefixed}, n.rn, n.{at} + {ttl} AS expires_at,
                     row_number() OVER (PARTITION BY {prefixed} ORDER BY n.rn) AS pick
              FROM {name}_anchors a JOIN {name}_rows n ON {same} AND n.rn > a.rn AND n.{at} >= a.expires_at) t
            WHERE pick = 1""",
        f"{name}_marked": f"""
            SELECT n.*, max(a.rn) OVER (PARTITION BY {prefixed} ORDER BY n.rn) AS anchor_rn
            FROM {name}_rows n LEFT JOIN {name}_anchors a ON {same} AND a.rn = n.rn""",
        name: f"""
            SELECT m.*, m.rn = m.anchor_rn AS acquired, own.{owner} AS holder, own.{at} AS held_since
            FROM {name}_marked m JOIN {name}_rows own ON {same_own} AND own.rn = m.anchor_rn""",
    }


def _json_log() -> str:
    fields = [("eventId", "event_id"), ("transactionId", "transaction_id"), ("idempotencyKey", "idempotency_key"),
              ("merchantId", "merchant_id"), ("accountId", "account_id"), ("amount", None), ("currency", "currency"),
              ("type", "type"), ("status", "status"), ("callbackUrl", "callback_url"),
              ("correlationId", "correlation_id"), ("processedAt", f"strftime(processed_at, {STAMP})")]
    parts = []
    for field, column in fields:
        if column is None:
            parts.append("'\"amount\":' || CAST(amount AS VARCHAR)")
        else:
            parts.append(f"""'"{field}":"' || {column} || '"'""")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


PARTS: dict[str, str] = {
    "deliveries": """
        SELECT event_id, ts, user_id, event_type, value, regexp_extract(props, '([0-9]+)', 1) AS k,
               0 AS delivery_no, ts AS created_at FROM events
        UNION ALL
        SELECT event_id, ts, user_id, event_type, value, regexp_extract(props, '([0-9]+)', 1) AS k,
               1 AS delivery_no, ts + INTERVAL 1 MINUTE AS created_at FROM events WHERE event_id % 97 = 5""",
    "requests": """
        SELECT event_id AS seq, delivery_no,
          sha256('tx-' || CAST(event_id AS VARCHAR) || ':requested') AS event_id,
          'tx-' || CAST(event_id AS VARCHAR) AS transaction_id,
          CASE WHEN event_id % 107 = 2 THEN NULL ELSE 'idem-' || CAST(user_id AS VARCHAR) || '-' || k END AS idempotency_key,
          CASE WHEN event_id % 127 = 6 THEN NULL ELSE 'merchant-' || CAST(user_id % 7 AS VARCHAR) END AS merchant_id,
          CASE WHEN event_id % 103 = 1 THEN '  '
               ELSE 'acct-' || lpad(CAST(user_id % 100000000 AS VARCHAR), 8, '0') END AS account_id,
          CAST(CASE WHEN event_id % 101 = 0 THEN -value ELSE value END AS DECIMAL(18,2)) AS amount,
          CASE WHEN event_id % 109 = 3 THEN '' WHEN user_id % 3 = 0 THEN 'INR' WHEN user_id % 3 = 1 THEN 'USD'
               ELSE 'EUR' END AS currency,
          CASE WHEN event_id % 113 = 4 THEN NULL WHEN event_type = 'purchase' THEN 'DEBIT'
               WHEN event_type = 'view' THEN 'REFUND' WHEN event_type = 'signup' THEN 'REVERSAL' ELSE 'CREDIT' END AS type,
          CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN '   '
               ELSE 'https://merchant-' || CAST(user_id % 7 AS VARCHAR) || '.example/webhook' END AS callback_url,
          'corr-' || CAST(event_id AS VARCHAR) AS correlation_id,
          created_at
        FROM deliveries""",
    "checked": """
        SELECT *, CASE WHEN amount IS NULL OR amount <= 0 THEN 'amount must be greater than zero'
                       WHEN account_id IS NULL OR trim(account_id) = '' THEN 'accountId must not be blank'
                       WHEN idempotency_key IS NULL OR trim(idempotency_key) = '' THEN 'idempotencyKey must not be blank'
                       WHEN currency IS NULL OR trim(currency) = '' THEN 'currency must not be blank'
                       WHEN type IS NULL THEN 'type must not be null' END AS reject_reason
        FROM requests""",
    "valid_requests": "SELECT * FROM checked WHERE reject_reason IS NULL",
    **_holds("held", "valid_requests", "idempotency_key", "created_at", "INTERVAL 48 HOUR", "transaction_id"),
    **_holds("scoped", "valid_requests", "merchant_id, idempotency_key", "created_at", "INTERVAL 48 HOUR", "transaction_id"),
    "outcomes": """
        SELECT *, CASE WHEN acquired THEN 'PROCESSED' WHEN transaction_id = holder THEN 'DUPLICATE_REPLAY'
                       ELSE 'DUPLICATE_REJECTED' END AS outcome FROM held""",
    "accepted": """
        SELECT seq, delivery_no,
               sha256(transaction_id || ':' || CAST(created_at AS VARCHAR) || ':accepted') AS event_id,
               transaction_id, idempotency_key, merchant_id, account_id, amount, currency, type,
               'ACCEPTED' AS status, callback_url, correlation_id, created_at AS processed_at
        FROM outcomes WHERE outcome = 'PROCESSED'""",
    "delivered": """
        SELECT *, 0 AS copy_no FROM accepted UNION ALL SELECT *, 1 AS copy_no FROM accepted WHERE seq % 89 = 8""",
    "constrained": """
        SELECT *, CASE WHEN merchant_id IS NULL THEN 'merchant_id is null' END AS violation FROM delivered""",
    "eligible": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY account_id, idempotency_key
                                       ORDER BY processed_at, seq, delivery_no) AS place
          FROM accepted WHERE merchant_id IS NOT NULL) t
        WHERE place = 1""",
    # A consumer has seen a third of the log; then the whole log is judged against what it stored.
    "seen_third": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY account_id, idempotency_key
                                       ORDER BY processed_at, seq, delivery_no) AS place
          FROM accepted WHERE merchant_id IS NOT NULL AND seq % 3 = 0) t
        WHERE place = 1""",
    "entered_later": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY account_id, idempotency_key
                                       ORDER BY processed_at, seq, delivery_no) AS place
          FROM accepted a
          WHERE merchant_id IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM seen_third s
            WHERE s.account_id = a.account_id AND s.idempotency_key = a.idempotency_key)) t
        WHERE place = 1""",
    # Ledger written from empty: the first copy of each eligible transaction enters.
    "labelled": """
        SELECT c.*, CASE WHEN violation IS NOT NULL OR e.transaction_id IS NULL THEN 'FAILED'
                         WHEN c.copy_no = 0 THEN 'INSERTED' ELSE 'SKIPPED' END AS disposition,
               CASE WHEN violation IS NOT NULL THEN violation
                    WHEN e.transaction_id IS NULL THEN 'account_idempotency_conflict' END AS reason
        FROM constrained c LEFT JOIN eligible e ON e.transaction_id = c.transaction_id""",
    # Ledger that already holds every tenth eligible transaction.
    "stored": "SELECT * FROM eligible WHERE seq % 10 = 9",
    "relabelled": """
        SELECT c.*, CASE WHEN violation IS NOT NULL OR e.transaction_id IS NULL THEN 'FAILED'
                         WHEN s.transaction_id IS NOT NULL OR c.copy_no > 0 THEN 'SKIPPED'
                         ELSE 'INSERTED' END AS disposition
        FROM constrained c LEFT JOIN eligible e ON e.transaction_id = c.transaction_id
        LEFT JOIN stored s ON s.transaction_id = c.transaction_id""",
    "audit": """
        SELECT sha256(event_id || ':' || CAST(copy_no AS VARCHAR) || ':audit') AS id, event_id, transaction_id,
               idempotency_key, merchant_id, account_id, correlation_id, amount, currency, type, status, processed_at,
               processed_at AS stored_at, 'transaction_log' AS source_topic FROM delivered""",
    "reduced": "SELECT * FROM eligible WHERE seq % 53 <> 7",
    "recent_audit": f"SELECT * FROM audit WHERE processed_at >= {WINDOW_START}",
    "recent_ledger": f"SELECT * FROM reduced WHERE processed_at >= {WINDOW_START}",
    "missing": """
        SELECT transaction_id FROM recent_audit EXCEPT SELECT transaction_id FROM recent_ledger""",
    "raw": f"""
        SELECT *, seq % 6 AS source_partition,
               CASE WHEN seq % 41 = 5 THEN 'TRANSFER' ELSE type END AS sent_type,
               '{{' || {_text('transactionId', 'transaction_id')} || ',' || {_text('idempotencyKey', 'idempotency_key')}
               || ',' || {_text('merchantId', 'merchant_id')} || ',' || {_text('accountId', 'account_id')}
               || ',"amount":' || CASE WHEN seq % 37 = 3 THEN '"ten"' ELSE CAST(amount AS VARCHAR) END
               || ',' || {_text('currency', 'currency')}
               || ',' || {_text('type', "CASE WHEN seq % 41 = 5 THEN 'TRANSFER' ELSE type END")}
               || ',' || {_text('callbackUrl', 'callback_url')} || ',' || {_text('correlationId', 'correlation_id')}
               || ',' || {_text('createdAt', f'strftime(created_at, {STAMP})')} || '}}' AS whole
        FROM checked""",
    "cut": """
        SELECT *, CASE WHEN seq % 31 = 0 THEN substr(whole, 1, length(whole) - 1) ELSE whole END AS value FROM raw""",
    "decoded": """
        SELECT *, NOT json_valid(value)
                  OR CASE WHEN json_valid(value) THEN
                       TRY_CAST(json_extract_string(value, '$.amount') AS DECIMAL(18,2)) IS NULL
                       OR coalesce(json_extract_string(value, '$.type') NOT IN ('DEBIT', 'CREDIT', 'REFUND', 'REVERSAL'),
                                   false)
                     ELSE true END AS undecodable
        FROM cut""",
    "letters": f"""
        SELECT 'transaction_requests_dlt' AS topic, source_partition, seq, delivery_no, 0 AS copy_no,
               CASE WHEN undecodable THEN 'undecodable payload' ELSE reject_reason END AS reason,
               CASE WHEN undecodable THEN NULL ELSE 'REJECTED' END AS status, value AS payload
        FROM decoded WHERE undecodable OR reject_reason IS NOT NULL
        UNION ALL
        SELECT 'transaction_log_dlt', seq % 6, seq, delivery_no, copy_no, reason, 'FAILED', {_json_log()}
        FROM labelled WHERE disposition = 'FAILED'""",
    # The processor fed with the records as they were sent: only what decodes and is valid is folded.
    "sendable": "SELECT * FROM decoded WHERE NOT undecodable AND reject_reason IS NULL",
    **_holds("streamed", "sendable", "idempotency_key", "created_at", "INTERVAL 48 HOUR", "transaction_id"),
    "concluded": """
        SELECT *, CASE WHEN acquired THEN 'PROCESSED' WHEN transaction_id = holder THEN 'DUPLICATE_REPLAY'
                       ELSE 'DUPLICATE_REJECTED' END AS outcome FROM streamed""",
    "stream_notices": """
        SELECT seq, delivery_no, callback_url, transaction_id, correlation_id, created_at AS occurred_at,
               CASE WHEN outcome = 'DUPLICATE_REJECTED' THEN 'REJECTED' ELSE 'ACCEPTED' END AS status FROM concluded
        UNION ALL
        SELECT seq, delivery_no, callback_url, transaction_id, correlation_id, created_at, 'REJECTED'
        FROM decoded WHERE NOT undecodable AND reject_reason IS NOT NULL""",
    "logged": "SELECT * FROM concluded WHERE outcome = 'PROCESSED'",
    "entered": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY account_id, idempotency_key ORDER BY created_at, seq, delivery_no) AS place
          FROM logged WHERE merchant_id IS NOT NULL) t
        WHERE place = 1""",
    "processor_updates": """
        SELECT callback_url, transaction_id, CASE WHEN outcome = 'DUPLICATE_REJECTED' THEN 'REJECTED' ELSE 'ACCEPTED' END
               AS status, correlation_id, created_at AS occurred_at, seq, delivery_no, 1 AS stage_no, 0 AS copy_no
        FROM outcomes
        UNION ALL
        SELECT callback_url, transaction_id, 'REJECTED', correlation_id, created_at, seq, delivery_no, 1, 0
        FROM checked WHERE reject_reason IS NOT NULL""",
    "updates": """
        SELECT * FROM processor_updates
        UNION ALL
        SELECT callback_url, transaction_id, CASE WHEN disposition = 'FAILED' THEN 'FAILED' ELSE 'PERSISTED' END,
               correlation_id, processed_at, seq, delivery_no, 2, copy_no FROM labelled""",
    "dispatched": """
        SELECT sha256(transaction_id || ':' || CAST(delivery_no AS VARCHAR) || ':' || CAST(copy_no AS VARCHAR) || ':'
                      || status || ':' || CASE WHEN stage_no = 1 THEN 'processor' ELSE 'ledger' END) AS event_id, *
        FROM updates WHERE callback_url IS NOT NULL AND trim(callback_url) <> ''""",
    "signed": """
        SELECT seq, delivery_no, merchant_id, 'nonce-' || CAST(seq % 5000 AS VARCHAR) AS nonce,
          idempotency_key AS idem_header,
          CASE WHEN seq % 13 = 7 THEN 'other-' || idempotency_key ELSE idempotency_key END AS body_key,
          '{"accountId":"' || account_id || '","amount":' || CAST(amount AS VARCHAR) || ',"note":"'
            || repeat('x', 60) || '"}' AS body,
          CASE WHEN seq % 19 = 3 THEN 'not-a-time'
               ELSE strftime(created_at - to_minutes(delivery_no), '%Y-%m-%dT%H:%M:%SZ') END AS ts_header,
          CASE WHEN seq % 17 = 2 THEN created_at + INTERVAL 121 SECOND ELSE created_at END AS received_at
        FROM requests""",
    "expected": """
        SELECT *, upper(sha256(to_base64(encode(body)) || '/api/v1/transactions' || ts_header || nonce || idem_header
                               || 'salt-' || merchant_id)) || '###1' AS right_value FROM signed""",
    "verified": """
        SELECT *, CASE WHEN seq % 11 = 4 THEN 'WRONG###1' ELSE right_value END AS verify,
               try_strptime(ts_header, '%Y-%m-%dT%H:%M:%SZ') AS sent FROM expected""",
    "judged": """
        SELECT *, CASE WHEN merchant_id IS NULL OR idem_header IS NULL OR verify IS NULL THEN 'Missing required auth headers'
                       WHEN merchant_id IN ('merchant-5', 'merchant-6') THEN 'Unknown merchant'
                       WHEN sent IS NULL THEN 'Invalid timestamp format'
                       WHEN abs(floor(epoch(received_at)) - epoch(sent)) > 120
                         THEN 'Request timestamp outside allowed skew' END AS early,
               coalesce(verify <> right_value, false) AS wrong
        FROM verified""",
    "guarded": "SELECT seq, delivery_no, merchant_id, nonce, received_at, wrong FROM judged WHERE early IS NULL",
    **_holds("nonces", "guarded", "merchant_id, nonce", "received_at", "INTERVAL 2 MINUTE", "seq"),
    "calls": f"""
        SELECT CASE WHEN event_id % 61 = 0 THEN NULL ELSE 'key-' || CAST(user_id % 20 AS VARCHAR) END AS api_key,
               'tx-' || CAST(event_id + event_id % 3 * 1000000 AS VARCHAR) AS transaction_id, event_id, ts,
               CAST(floor(epoch(ts) / {derive.READ_WINDOW_SECONDS}) AS BIGINT) AS window_id
        FROM events""",
    "allowed_calls": f"""
        SELECT * FROM calls WHERE api_key IN (SELECT unnest(string_split('{derive.READ_API_KEYS}', ',')))""",
    "counted_calls": """
        SELECT *, row_number() OVER (PARTITION BY api_key, window_id ORDER BY ts, event_id) AS ordinal,
               CASE api_key WHEN 'key-1' THEN 5 WHEN 'key-3' THEN 4 ELSE 2 END AS key_limit FROM allowed_calls""",
    "owners": """
        SELECT * FROM (VALUES ('key-1', 'merchant-1'), ('key-1', 'merchant-2'), ('key-3', 'merchant-3'),
          ('key-3', 'merchant-4'), ('key-5', 'merchant-0'), ('key-5', 'merchant-5'), ('key-5', 'merchant-6'))
          AS o(api_key, merchant_id)""",
    "stored_settings": """
        SELECT c_custkey AS tenant_id,
          CASE WHEN c_custkey % 6 = 1 THEN NULL WHEN c_custkey % 6 = 2 THEN '  '
               ELSE ' key-' || c_custkey % 5 || ', key-' || c_custkey % 7 || ',, ' || chr(9) || 'key-' || c_custkey % 5 || ' ,'
               END AS api_keys,
          CASE WHEN c_custkey % 8 = 3 THEN NULL
               ELSE 'key-1:' || c_custkey % 9 || ', key-2:not-a-number, broken, key-4:, :7, key-5:5.0, key-'
                    || c_custkey % 3 || ': +' || c_custkey % 4 || ' ,key-6:3000000000' END AS rate_limits,
          CASE WHEN c_custkey % 10 = 4 THEN NULL
               ELSE 'key-1:merchant-' || c_custkey % 4 || '|merchant-' || c_custkey % 3
                    || ',key-2:,missing,key-3:merchant-3||merchant-' || c_custkey % 6
                    || ',key-4: | ,key-' || c_custkey % 2 || ':merchant-9' END AS api_key_merchants,
          CASE c_custkey % 7 WHEN 0 THEN '60' WHEN 1 THEN ' 120 ' WHEN 2 THEN 'abc' WHEN 3 THEN '-5' WHEN 4 THEN '5.0'
               WHEN 5 THEN ' ' END AS rate_window_seconds,
          CASE c_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '+25' WHEN 2 THEN '99999999999'
               WHEN 3 THEN CAST(c_custkey % 50 AS VARCHAR) END AS default_limit_per_window
        FROM customer""",
    "settings": """
        SELECT tenant_id, coalesce(nullif(trim(api_keys), ''), 'key-0,key-1') AS api_keys,
          coalesce(nullif(trim(rate_limits), ''), 'key-0:10') AS rate_limits,
          coalesce(nullif(trim(api_key_merchants), ''), 'key-0:merchant-0') AS api_key_merchants,
          greatest(1, coalesce(CASE WHEN regexp_full_match(trim(rate_window_seconds), '[+-]?[0-9]+')
            THEN TRY_CAST(trim(rate_window_seconds) AS INTEGER) END, 60)) AS rate_window_seconds,
          greatest(1, coalesce(CASE WHEN regexp_full_match(trim(default_limit_per_window), '[+-]?[0-9]+')
            THEN TRY_CAST(trim(default_limit_per_window) AS INTEGER) END, 120)) AS default_limit_per_window
        FROM stored_settings""",
    "limit_entries": """
        SELECT tenant_id, e, p, trim(split_part(e, ':', 1)) AS api_key, trim(substr(e, strpos(e, ':') + 1)) AS v
        FROM (SELECT tenant_id, unnest(string_split(rate_limits, ',')) AS e,
                     generate_subscripts(string_split(rate_limits, ','), 1) AS p FROM settings) t
        WHERE strpos(e, ':') > 0""",
    "merchant_entries": """
        SELECT tenant_id, p, trim(split_part(e, ':', 1)) AS api_key, trim(substr(e, strpos(e, ':') + 1)) AS v
        FROM (SELECT tenant_id, unnest(string_split(api_key_merchants, ',')) AS e,
                     generate_subscripts(string_split(api_key_merchants, ','), 1) AS p FROM settings) t
        WHERE strpos(e, ':') > 0""",
    "loads": """
        SELECT CASE WHEN event_type = 'error' THEN 503 ELSE 202 END AS status, value AS duration_ms FROM events""",
    "load_row": """
        SELECT count(*) AS iterations, count(*) FILTER (status = 202) AS accepted,
          count(*) FILTER (status <> 202) AS failed,
          round(count(*) FILTER (status NOT BETWEEN 200 AND 399) / count(*), 6) AS http_failed_rate,
          round(count(*) FILTER (status = 202) / count(*), 6) AS status_202_rate,
          round((count(*) FILTER (status = 202) + count(*) FILTER (duration_ms < 10000)) / (2 * count(*)), 6) AS checks_rate,
          round(count(*) FILTER (status = 202 AND duration_ms < 10000) / count(*), 6) AS app_check_rate,
          round(avg(duration_ms), 6) AS avg_ms, round(min(duration_ms), 6) AS min_ms, round(max(duration_ms), 6) AS max_ms,
          round(avg(duration_ms) FILTER (status = 202), 6) AS accepted_avg_ms,
          round(quantile_cont(duration_ms, 0.5), 6) AS med_ms, round(quantile_cont(duration_ms, 0.9), 6) AS p90_ms,
          round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 6) AS p99_ms
        FROM loads""",
}

def _sql(statement: str) -> str:
    wanted: list[str] = []
    padded = f" {statement} ".replace("\n", " ").replace(")", " ")

    def need(name: str) -> None:
        if name not in wanted:
            for other in _NEEDS[name]:
                need(other)
            wanted.append(name)

    for name in PARTS:
        if f" {name} " in padded:
            need(name)
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in wanted)
    return f"WITH RECURSIVE {parts}\n{statement}" if wanted else statement


_LEDGER_COLUMNS = """transaction_id, idempotency_key, merchant_id, account_id, amount, currency, type,
    'PERSISTED' AS status, processed_at, processed_at AS created_at"""
_ERRORS = """CASE WHEN trim(account_id) = '' THEN 'accountId=accountId is required' END,
    CASE WHEN amount < 0.01 THEN 'amount=amount must be greater than 0' END,
    CASE WHEN callback_url IS NOT NULL AND NOT regexp_full_match(callback_url, 'https?://.+')
         THEN 'callbackUrl=callbackUrl must be a valid http(s) URL' END,
    CASE WHEN trim(currency) = '' THEN 'currency=currency is required' END,
    CASE WHEN idempotency_key IS NULL THEN 'idempotencyKey=idempotencyKey is required' END,
    CASE WHEN type IS NULL THEN 'type=type is required' END"""
_IDENTITY = "CAST(seq AS VARCHAR) || ':' || CAST(delivery_no AS VARCHAR)"
_NOTE = "'Missing transactionIds in ledger: '"


def _run(audit: str, ledger: str) -> str:
    return f"""
        SELECT TIMESTAMP '2024-01-31 00:00:00' AS run_at, {WINDOW_START} AS window_start, audit_count, ledger_count,
               missing_in_ledger, CASE WHEN missing_in_ledger = 0 THEN 'OK' ELSE 'DRIFT_DETECTED' END AS status,
               CASE WHEN missing_in_ledger = 0 THEN 'Ledger matches audit window' ELSE {_NOTE} || ids END AS notes
        FROM (SELECT (SELECT count(*) FROM {audit} ) AS audit_count, (SELECT count(*) FROM {ledger} ) AS ledger_count,
                (SELECT count(*) FROM (SELECT transaction_id FROM {audit} EXCEPT SELECT transaction_id FROM {ledger} ) x)
                  AS missing_in_ledger,
                (SELECT string_agg(transaction_id, ',' ORDER BY transaction_id) FROM (
                   SELECT transaction_id FROM (SELECT transaction_id FROM {audit} EXCEPT
                     SELECT transaction_id FROM {ledger} ) y
                   ORDER BY transaction_id LIMIT 20) z) AS ids) t"""


_ANSWERED = f"""
    SELECT r.*, j.received_at, sha256(CAST(r.seq AS VARCHAR) || ':' || CAST(r.delivery_no AS VARCHAR) || ':transaction') AS new_id,
           CASE WHEN j.early IS NOT NULL THEN j.early WHEN NOT n.acquired THEN 'Replay detected'
                WHEN j.wrong THEN 'Invalid signature' END AS verdict, concat_ws(';', {_ERRORS}) AS errors
    FROM requests r JOIN judged j USING (seq, delivery_no) LEFT JOIN nonces n USING (seq, delivery_no)"""
PARTS["answered"] = _ANSWERED
PARTS["sent_on"] = """
    SELECT seq, delivery_no, new_id AS transaction_id, idempotency_key, received_at AS created_at
    FROM answered WHERE verdict IS NULL AND errors = ''"""
PARTS |= _holds("chained", "sent_on", "idempotency_key", "created_at", "INTERVAL 48 HOUR", "transaction_id")

# What each part reads, taken from its text.
_NEEDS = {
    name: [other for other in PARTS if other != name and f" {other} " in f" {text} ".replace("\n", " ").replace(")", " ")
           .replace(";", " ")]
    for name, text in PARTS.items()
}

_STATEMENTS: dict[str, str] = {
    "validate_first_failure": "SELECT seq, delivery_no, reject_reason FROM checked ",
    "ingress_field_errors": f"""
        SELECT seq, delivery_no, CAST(len(list_filter([{_ERRORS}], lambda x: x IS NOT NULL)) AS INTEGER) AS errors,
               concat_ws(';', {_ERRORS}) AS field_errors FROM requests """,
    "ingress_error_counts": f"""
        SELECT split_part(e, '=', 1) AS field, split_part(e, '=', 2) AS message, count(*) AS n
        FROM (SELECT unnest([{_ERRORS}]) AS e FROM requests ) t WHERE e IS NOT NULL GROUP BY ALL""",
    "ingress_enrich": f"""
        SELECT seq, delivery_no, sha256({_IDENTITY} || ':event') AS event_id,
               sha256({_IDENTITY} || ':transaction') AS transaction_id, idempotency_key, merchant_id, account_id, amount,
               currency, type, callback_url,
               CASE WHEN seq % 5 IN (0, 1) THEN sha256({_IDENTITY} || ':correlation') ELSE correlation_id END AS correlation_id,
               created_at, 'RECEIVED' AS response_status FROM requests """,
    "decode_corrupt_split": """
        SELECT seq, delivery_no, undecodable, CASE WHEN NOT undecodable THEN transaction_id END AS transaction_id,
               CASE WHEN NOT undecodable THEN amount END AS amount, CASE WHEN NOT undecodable THEN sent_type END AS type,
               CASE WHEN NOT undecodable THEN created_at END AS created_at FROM decoded """,
    "idempotency_first_wins": """
        SELECT seq, delivery_no, idempotency_key,
               row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, seq, delivery_no) = 1 AS first
        FROM valid_requests """,
    "idempotency_ttl": "SELECT seq, delivery_no, idempotency_key, outcome, holder, held_since FROM outcomes ",
    "idempotency_ttl_scoped": """
        SELECT seq, delivery_no, merchant_id, idempotency_key,
               CASE WHEN acquired THEN 'PROCESSED' WHEN transaction_id = holder THEN 'DUPLICATE_REPLAY'
                    ELSE 'DUPLICATE_REJECTED' END AS outcome, holder, held_since FROM scoped """,
    "outcome_summary": "SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome",
    "accepted_log": "SELECT * FROM accepted ",
    "account_sequence": """
        SELECT seq, delivery_no, account_id, processed_at,
               row_number() OVER (PARTITION BY account_id ORDER BY processed_at, seq, delivery_no) AS account_seq
        FROM accepted """,
    "nonce_replay": """
        SELECT seq, delivery_no, merchant_id, nonce, early AS verdict FROM judged WHERE early IS NOT NULL
        UNION ALL
        SELECT seq, delivery_no, merchant_id, nonce, CASE WHEN NOT acquired THEN 'Replay detected'
               WHEN wrong THEN 'Invalid signature' ELSE 'OK' END FROM nonces """,
    "ledger_constraint_check": """
        SELECT seq, delivery_no, transaction_id, CASE WHEN merchant_id IS NULL THEN 'merchant_id is null' END AS violation
        FROM accepted """,
    "ledger_unique_conflicts": """
        SELECT seq, delivery_no, copy_no, transaction_id, account_id, idempotency_key FROM labelled
        WHERE reason = 'account_idempotency_conflict'""",
    "ledger_rows": f"SELECT {_LEDGER_COLUMNS} FROM accepted WHERE merchant_id IS NOT NULL",
    "ledger_insert_if_absent": f"SELECT {_LEDGER_COLUMNS} FROM relabelled WHERE disposition = 'INSERTED'",
    "ledger_batch_counters": """
        SELECT CAST(floor(seq / 200) AS BIGINT) AS batch_id, count(*) AS total_events,
               count(*) FILTER (disposition = 'INSERTED') AS inserted, count(*) FILTER (disposition = 'SKIPPED') AS skipped,
               count(*) FILTER (disposition = 'FAILED') AS failed FROM relabelled GROUP BY 1""",
    "log_batch_summary": """
        SELECT CAST(floor(seq / 200) AS BIGINT) AS batch_id, count(*) AS events,
               first(transaction_id ORDER BY processed_at, seq, delivery_no, copy_no) AS first_transaction_id,
               last(transaction_id ORDER BY processed_at, seq, delivery_no, copy_no) AS last_transaction_id
        FROM delivered GROUP BY 1""",
    "audit_append": "SELECT * FROM audit ",
    "ledger_since": "SELECT transaction_id, processed_at FROM recent_ledger ",
    "audit_since": "SELECT id, transaction_id, processed_at FROM recent_audit ",
    "reconcile_missing": "SELECT transaction_id FROM missing ",
    "reconcile_run": _run("recent_audit", "recent_ledger"),
    "reconcile_run_clean": _run(
        "(SELECT * FROM recent_audit WHERE transaction_id IN (SELECT transaction_id FROM reduced )) q", "recent_ledger"),
    "replay_rebuild_ledger": f"SELECT {_LEDGER_COLUMNS} FROM eligible ",
    "terminal_status": "SELECT topic, reason, status, count(*) AS n FROM letters GROUP BY ALL",
    "dead_letter_route": "SELECT * FROM letters ",
    "webhook_dispatch": "SELECT * FROM dispatched ",
    "webhook_payloads": f"""
        SELECT callback_url, CAST(floor((place - 1) / 100) AS BIGINT) AS chunk_no, count(*) AS updates,
               '[' || string_agg('{{"transactionId":"' || transaction_id || '","status":"' || status || '","correlationId":"'
                 || correlation_id || '","occurredAt":"' || strftime(occurred_at, {STAMP}) || '"}}', ',' ORDER BY place)
               || ']' AS payload
        FROM (SELECT *, row_number() OVER (PARTITION BY callback_url
                ORDER BY occurred_at, seq, delivery_no, stage_no, copy_no) AS place FROM dispatched ) t
        GROUP BY 1, 2""",
    "webhook_batch_stats": """
        SELECT CAST(floor(seq / 100) AS BIGINT) AS batch_id, count(*) AS events,
               count(DISTINCT CASE WHEN trim(callback_url) <> '' THEN callback_url END) AS addresses
        FROM processor_updates GROUP BY 1""",
    "config_keys": r"""
        SELECT DISTINCT tenant_id, k AS api_key
        FROM (SELECT tenant_id, regexp_replace(unnest(string_split(api_keys, ',')), '^\s+|\s+$', '', 'g') AS k
              FROM settings ) t WHERE k <> ''""",
    "config_limits": """
        SELECT tenant_id, api_key, CAST(arg_max(n, p) AS INTEGER) AS key_limit
        FROM (SELECT *, TRY_CAST(v AS INTEGER) AS n FROM limit_entries
              WHERE api_key <> '' AND regexp_full_match(v, '[+-]?[0-9]+')) t
        WHERE n IS NOT NULL GROUP BY 1, 2""",
    "config_merchants": """
        SELECT DISTINCT tenant_id, api_key, m AS merchant_id
        FROM (SELECT tenant_id, api_key, unnest(list_transform(string_split(v, '|'), lambda x: trim(x))) AS m
              FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, api_key ORDER BY p DESC) AS last
                    FROM merchant_entries WHERE api_key <> '' AND trim(replace(v, '|', '')) <> '') t
              WHERE last = 1) u
        WHERE m <> ''""",
    "config_effective": "SELECT * FROM settings ",
    "rate_window_counts": """
        SELECT api_key, window_id, count(*) AS calls FROM allowed_calls GROUP BY 1, 2""",
    "rate_limit_verdict": """
        SELECT event_id, api_key, window_id, ordinal, key_limit, CASE WHEN ordinal > key_limit THEN 429 ELSE 200 END AS status,
               CASE WHEN ordinal > key_limit THEN 'Rate limit exceeded' END AS message FROM counted_calls
        UNION ALL
        SELECT event_id, api_key, window_id, NULL, NULL, 401,
               CASE WHEN api_key IS NULL THEN 'Missing API key' ELSE 'Invalid API key' END
        FROM calls WHERE event_id NOT IN (SELECT event_id FROM allowed_calls )""",
    "status_lookup": """
        SELECT event_id, api_key, transaction_id, code, CASE WHEN code = 200 THEN 'PERSISTED' END AS status,
               CASE WHEN code = 200 THEN processed_at END AS processed_at
        FROM (SELECT c.event_id, c.api_key, c.transaction_id, e.processed_at,
                CASE WHEN a.event_id IS NULL THEN 401 WHEN e.transaction_id IS NULL THEN 404
                     WHEN o.api_key IS NULL THEN 403 ELSE 200 END AS code
              FROM calls c LEFT JOIN allowed_calls a ON a.event_id = c.event_id
              LEFT JOIN eligible e ON e.transaction_id = c.transaction_id
              LEFT JOIN owners o ON o.api_key = c.api_key AND o.merchant_id = e.merchant_id) t""",
    "signature_audit": """
        SELECT seq, delivery_no, merchant_id, coalesce(early, CASE WHEN wrong THEN 'Invalid signature' ELSE 'OK' END) AS verdict,
               coalesce(idem_header <> body_key, false) AS key_mismatch FROM judged """,
    "body_hash": "SELECT seq, delivery_no, to_base64(unhex(sha256(body))) AS body_hash FROM signed ",
    "ingress_stream": """
        SELECT seq, delivery_no, CASE WHEN verdict IS NOT NULL THEN 401 WHEN errors <> '' THEN 400 ELSE 202 END AS code,
               CASE WHEN verdict IS NOT NULL THEN verdict WHEN errors <> '' THEN 'Validation failed' END AS message,
               CASE WHEN verdict IS NULL AND errors <> '' THEN errors END AS field_errors,
               CASE WHEN verdict IS NULL AND errors = '' THEN new_id END AS transaction_id,
               CASE WHEN verdict IS NULL AND errors = '' THEN 'RECEIVED' END AS status
        FROM answered """,
    "ingress_chain_stream": """
        SELECT seq, delivery_no, transaction_id,
               CASE WHEN acquired THEN 'PROCESSED' WHEN transaction_id = holder THEN 'DUPLICATE_REPLAY'
                    ELSE 'DUPLICATE_REJECTED' END AS outcome,
               CASE WHEN acquired OR transaction_id = holder THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, NULL AS reason
        FROM chained """,
    "processor_stream": """
        SELECT seq, delivery_no, transaction_id, outcome,
               CASE WHEN outcome = 'DUPLICATE_REJECTED' THEN 'REJECTED' ELSE 'ACCEPTED' END AS status, NULL AS reason
        FROM concluded
        UNION ALL
        SELECT seq, delivery_no, CASE WHEN NOT undecodable THEN transaction_id END,
               CASE WHEN undecodable THEN 'UNDECODABLE' ELSE 'INVALID' END, CASE WHEN NOT undecodable THEN 'REJECTED' END,
               CASE WHEN undecodable THEN 'undecodable payload' ELSE reject_reason END
        FROM decoded WHERE undecodable OR reject_reason IS NOT NULL""",
    "processor_letters_stream": "SELECT * FROM letters WHERE topic = 'transaction_requests_dlt'",
    "processor_notices_stream": """
        SELECT sha256(transaction_id || ':' || CAST(delivery_no AS VARCHAR) || ':0:' || status || ':processor') AS event_id,
               callback_url, transaction_id, status, correlation_id, occurred_at
        FROM stream_notices WHERE callback_url IS NOT NULL AND trim(callback_url) <> ''""",
    "service_chain_stream": """
        SELECT l.transaction_id, count(*) AS documents, bool_or(e.transaction_id IS NOT NULL) AS in_ledger,
               max(CASE WHEN trim(l.callback_url) <> '' THEN
                     CASE WHEN e.transaction_id IS NULL THEN 'FAILED' ELSE 'PERSISTED' END END) AS told
        FROM logged l LEFT JOIN entered e ON e.transaction_id = l.transaction_id GROUP BY 1""",
    "load_summary": "SELECT * FROM load_row ",
    "load_thresholds": """
        SELECT unnest(['http_req_failed', 'status_202_rate', 'checks', 'app_check_rate', 'http_req_duration',
                       'http_req_duration']) AS metric,
               unnest(['rate==0', 'rate==1', 'rate==1', 'rate==1', 'p(95)<1000', 'p(99)<2000']) AS rule,
               unnest([http_failed_rate, status_202_rate, checks_rate, app_check_rate, p95_ms, p99_ms]) AS observed,
               unnest([http_failed_rate = 0, status_202_rate = 1, checks_rate = 1, app_check_rate = 1, p95_ms < 1000,
                       p99_ms < 2000]) AS passed FROM load_row """,
}
for _stream, _batch in (("idempotency_ttl_stream", "idempotency_ttl"), ("rate_window_counts_stream", "rate_window_counts"),
                        ("ledger_stream", "replay_rebuild_ledger"), ("audit_stream", "audit_append"),
                        ("webhook_payloads_stream", "webhook_payloads")):
    _STATEMENTS[_stream] = _STATEMENTS[_batch]
# The consumer of the dispatch stream sees the ledger's notifications, and orders them by what they carry.
_STATEMENTS["webhook_payloads_stream"] = (_STATEMENTS["webhook_payloads_stream"]
    .replace("ORDER BY occurred_at, seq, delivery_no, stage_no, copy_no", "ORDER BY occurred_at, event_id")
    .replace("FROM dispatched ", "FROM (SELECT * FROM dispatched WHERE stage_no = 2) u "))
_STATEMENTS["replay_into_ledger"] = (
    f"SELECT {_LEDGER_COLUMNS} FROM seen_third UNION ALL SELECT {_LEDGER_COLUMNS} FROM entered_later ")

ORACLES: dict[str, str] = {name: _sql(statement) for name, statement in _STATEMENTS.items()}
