"""They must equal the served contract, so they stand here as plain text."""

# Transaction types and statuses.
TRANSACTION_TYPES = ("DEBIT", "CREDIT", "REFUND", "REVERSAL")
TRANSACTION_STATUSES = ("RECEIVED", "ACCEPTED", "REJECTED", "PERSISTED", "FAILED")

# Outcomes of the idempotency check.
PROCESSED = "PROCESSED"
DUPLICATE_REPLAY = "DUPLICATE_REPLAY"
DUPLICATE_REJECTED = "DUPLICATE_REJECTED"

# Reasons of the processor check, in the order they are tested.
AMOUNT_NOT_POSITIVE = "amount must be greater than zero"
ACCOUNT_BLANK = "accountId must not be blank"
KEY_BLANK = "idempotencyKey must not be blank"
CURRENCY_BLANK = "currency must not be blank"
TYPE_NULL = "type must not be null"

# Messages of the ingress check, by field.
KEY_REQUIRED = "idempotencyKey is required"
ACCOUNT_REQUIRED = "accountId is required"
AMOUNT_REQUIRED = "amount is required"
AMOUNT_TOO_SMALL = "amount must be greater than 0"
CURRENCY_REQUIRED = "currency is required"
TYPE_REQUIRED = "type is required"
CALLBACK_INVALID = "callbackUrl must be a valid http(s) URL"
CALLBACK_PATTERN = r"\Ahttps?://.+\z"
SMALLEST_AMOUNT = "0.01"

# Verdicts of the signature check, in the order they are tested.
HEADERS_MISSING = "Missing required auth headers"
MERCHANT_UNKNOWN = "Unknown merchant"
TIMESTAMP_INVALID = "Invalid timestamp format"
TIMESTAMP_SKEWED = "Request timestamp outside allowed skew"
NONCE_REPLAYED = "Replay detected"
SIGNATURE_INVALID = "Invalid signature"
SIGNATURE_OK = "OK"
SIGNATURE_SEPARATOR = "###"

# Messages of the read limiter.
API_KEY_MISSING = "Missing API key"
API_KEY_INVALID = "Invalid API key"
RATE_EXCEEDED = "Rate limit exceeded"

# Reconciliation texts.
RECONCILED = "OK"
DRIFTED = "DRIFT_DETECTED"
RECONCILED_NOTE = "Ledger matches audit window"
DRIFTED_NOTE = "Missing transactionIds in ledger: "
NOTED_IDS = 20

# Stream names and their partition count.
REQUEST_STREAM = "transaction_requests"
LOG_STREAM = "transaction_log"
WEBHOOK_STREAM = "webhook_dispatch"
DEAD_LETTER_SUFFIX = "_dlt"
STREAM_PARTITIONS = 6

# Widths of the ledger's text columns.
LEDGER_WIDTHS = {
    "transaction_id": 64,
    "idempotency_key": 128,
    "merchant_id": 64,
    "account_id": 64,
    "currency": 8,
    "type": 32,
}

# Default durations and batch sizes.
IDEMPOTENCY_TTL_HOURS = 48
NONCE_TTL_MINUTES = 2
ALLOWED_SKEW_SECONDS = 120
LEDGER_BATCH_ROWS = 200
WEBHOOK_BATCH_ROWS = 100

# Pass marks of a load run.
P95_CEILING_MS = 1000
P99_CEILING_MS = 2000
CHECK_CEILING_MS = 10000
