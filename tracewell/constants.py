"""Thresholds, weights, code tables, labels and catalogues.

Everything here is a value that results depend on, kept in one place.
"""

# Windows and thresholds.
LINK_WINDOW_SECONDS = 240
ASOF_TOLERANCE_MINUTES = 10
REPORTING_LIMIT = 50000.0
BAND_LOW = 30000.0
BURST_MIN_ROWS = 3
BURST_FACTOR = 1.5
BURST_WINDOW_SECONDS = 7200
BUFFER_ROWS = 20
BUFFER_HOURS = 24
DORMANT_DAYS = 30.0
FAST_MINUTES = 120.0
DECAY_LAMBDA = 1e-4
ALERT_THRESHOLD = 0.45
LINK_SCORE_THRESHOLD = 0.50
BURST_SCORE_THRESHOLD = 0.9
PROFILE_THRESHOLD = 0.3547236180904523

# Access-side code tables.
ROLES = ["loan_officer", "savings_representative", "branch_manager", "it_admin", "compliance_officer"]
ROLE_ACCOUNT_TYPES = {
    "loan_officer": ["loan", "mortgage"],
    "savings_representative": ["savings", "checking"],
    "branch_manager": ["loan", "mortgage", "savings", "checking", "business"],
    "it_admin": ["system", "audit"],
    "compliance_officer": ["loan", "mortgage", "savings", "checking", "business", "system", "audit"],
}
ROLE_THRESHOLDS = {
    "loan_officer": 0.054534481838345535,
    "savings_representative": 0.1601133458316327,
    "branch_manager": 0.12260177731513984,
    "it_admin": 0.1814980171620847,
    "compliance_officer": 0.07628491148352627,
}
ROLE_THRESHOLD_DEFAULT = 0.05

# Transaction type codes of the three feature builders, with the code for other types.
TYPE_CODES = {
    "link": ({"TRANSFER": 0, "CASH_OUT": 1, "PAYMENT": 2, "DEBIT": 3, "CREDIT": 4}, 0),
    "profile": ({"TRANSFER": 4, "CASH_OUT": 1, "PAYMENT": 3, "DEBIT": 2, "CREDIT": 0}, 4),
    "loader": ({"TRANSFER": 4, "CASH_OUT": 1}, 0),
}
LEDGER_TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
SCORED_TYPES = ["TRANSFER", "CASH_OUT"]

# Feature column orders.
LINK_FEATURES = [
    "time_delta_minutes", "amount", "amount_zscore", "role_account_match", "hour_of_access",
    "day_of_week", "records_accessed", "transaction_type_encoded", "is_suspicious",
]
ROLE_FEATURES = [
    "hour_of_day", "day_of_week", "records_accessed", "action_type_encoded", "account_type_encoded",
    "branch_code_encoded", "is_weekend", "is_off_hours", "records_accessed_zscore",
    "access_frequency_today", "same_branch_access", "action_type_rarity",
]
BURST_FEATURES = [
    "amount_normalised", "time_since_last_minutes", "is_below_threshold", "is_struct_band",
    "is_transfer", "is_fast", "roll_fast_3", "roll_struct_band_3", "cumulative_amount_window",
    "amount_homogeneity", "velocity_count", "balance_change_ratio",
]
LOADER_SEQUENCE_FEATURES = [
    "amount_norm", "time_since_last_steps", "is_below_threshold", "is_struct_band", "is_transfer",
    "rolling_velocity_3", "balance_change_ratio",
]
PROFILE_FEATURES = [
    "account_age_steps", "historical_mean_amount", "historical_std_amount", "historical_txn_count",
    "historical_max_amount", "days_since_last_transaction", "hour_of_day", "current_amount",
    "amount_vs_historical_mean_ratio", "amount_vs_historical_max_ratio", "is_new_counterparty",
    "balance_before", "balance_after", "balance_drop_ratio", "balance_is_zero_after",
    "type_matches_history", "is_dormant_account", "type_encoded", "errorBalanceOrig",
    "errorBalanceDest", "is_transfer",
]

# Detector weights.
RISK_WEIGHTS = {
    "temporal_link": 0.35,
    "circular_transfer": 0.25,
    "xgboost_profile": 0.20,
    "lstm_structuring": 0.15,
    "role_autoencoder": 0.05,
}
DOSSIER_WEIGHTS = {"isolation_forest": 0.40, "xgboost": 0.30, "lstm": 0.20, "autoencoder": 0.10}
JOINT_WEIGHTS = (0.85, 0.15)

# Detector labels shown in alerts, in firing order.
MODULE_LABELS = {
    "temporal_link": "Isolation Forest (4-Minute Temporal Link)",
    "circular_transfer": "Circular Transfer Detector (Saradha Ring)",
    "xgboost_profile": "XGBoost + SHAP (Profile Deviation)",
    "lstm_structuring": "LSTM + Attention (Structuring/Smurfing)",
    "role_autoencoder": "Role Autoencoder (Privilege Abuse)",
}
DOSSIER_LABELS = {
    "isolation_forest": "Isolation Forest (Temporal Link)",
    "autoencoder": "Role Autoencoder (Privilege Abuse)",
    "lstm": "LSTM + Attention (Structuring)",
    "xgboost": "XGBoost + SHAP (Profile Mismatch)",
}

# Alert action texts by severity.
ALERT_ACTIONS = {
    "CRITICAL": "IMMEDIATE HOLD on account out-transfers; notify AML Compliance and initiate forensic employee session audit.",
    "HIGH": "PRIORITY REVIEW: Dispatch case to Senior Investigator; trigger telephonic step-up customer verification.",
    "MEDIUM": "WATCHLIST MONITOR: Flag account for 72-hour step-up OTP authentication and audit trail capture.",
    "LOW": "LOGGED: Low anomaly baseline recorded to compliance stream.",
}
DOSSIER_ACTIONS = {
    "CRITICAL": "IMMEDIATE HOLD: Automated temporary hold on beneficiary account and notify Anti-Money Laundering (AML) Compliance desk.",
    "HIGH": "PRIORITY REVIEW: Route to Level-2 Fraud Investigator within 30 minutes; request telephonic step-up verification.",
    "MEDIUM": "WATCHLIST MONITOR: Flag account for enhanced monitoring over next 72 hours; enforce lower OTP limits.",
    "LOW": "LOGGED: Normal event logged to audit stream with no active intervention required.",
}

# Profile reasons (fixed texts): feature, explanation.
PROFILE_REASONS = {
    "amount_vs_historical_mean_ratio": "Transaction is far larger than this account's historical average — profile mismatch.",
    "is_dormant_account": "Account was dormant for >30 days and suddenly activated — dormant account hijacking pattern.",
    "balance_is_zero_after": "Balance is exactly INR 0 after transfer — complete account liquidation detected.",
}
PROFILE_REASON_CONTRIBUTIONS = {
    "is_dormant_account": 0.42,
    "amount_vs_historical_mean_ratio": 0.38,
    "balance_is_zero_after": 0.25,
}

# Incident catalogue: key, name, quantum, description, sections, trigger.
INCIDENTS = [
    ("temporal_link", "Citibank India Wealth Management Scam (2010)", "INR 400 Crore",
     "Relationship manager accessed dormant and HNW accounts to forge authorizations, moving funds out via unauthorized transfers right after internal logons.",
     "PMLA 2002 Section 3 (Offence of money laundering), IPC 420 (Cheating)",
     "RBI Master Direction on Fraud Classification (RBI/2016-17/13)"),
    ("circular_transfer", "Saradha Financial Syndicate Fraud (2013)", "INR 2,500 Crore",
     "Layered fund diversions across 300+ shell accounts designed to obscure original source and create fictitious commercial velocity.",
     "SEBI Collective Investment Scheme Regulations, PMLA Section 4",
     "FIU-IND Red Flag Indicator RFI-08 (Layered circular flows)"),
    ("structuring", "Hawala Syndicates & ED Smurfing Operations (Ongoing)", "Estimated INR 10,000+ Crore annually",
     "Criminal syndicates fragment large proceeds into multiple sub-INR 50,000 deposits/transfers across mule networks to bypass mandatory Cash Transaction Reports (CTR).",
     "PMLA 2002 Rule 3(1)(A) (Cash transaction threshold evasions)",
     "RBI CTR Reporting Directive (Mandatory reporting > INR 50,000)"),
    ("role_anomaly", "Punjab National Bank (PNB) Brady House Fraud (2018)", "INR 11,400 Crore",
     "Bank officials issued unauthorized Letters of Undertaking (LoUs) via SWIFT terminals during odd hours without matching Core Banking System (CBS) journal entries.",
     "Prevention of Corruption Act 1988, IPC 409 (Criminal breach of trust by banker)",
     "RBI Directive on SWIFT-CBS Integration & Role Separation"),
    ("profile_mismatch", "Jan Dhan Dormant Account Hijacking (2016, Post-Demonetization)", "INR 42,000+ Crore anomalous surges",
     "Dormant, low-volume savings accounts suddenly processing massive electronic credits and rapid cash withdrawals within days of cash currency replacement.",
     "Benami Transactions (Prohibition) Amendment Act 2016, PMLA Section 12",
     "Income Tax Department 'Operation Clean Money' Guidelines"),
]

# Scenario catalogue: id, title, description (own words); fixed values: expected events, replay speed.
SCENARIOS = [
    ("temporal_link", "Access followed by transfers", "An employee opens an account and money leaves it within four minutes.", 266, 500.0),
    ("structuring", "Bursts under the reporting limit", "Three or more transfers just below the limit within two hours that together exceed it.", 99, 500.0),
    ("circular_transfer", "Money that comes back", "Transfers over several accounts that close a ring.", 15, 200.0),
    ("clean_busy", "Busy but clean branch", "Many ordinary transactions that should raise nothing.", 255, 500.0),
]

# Graph display sizes and colours by node type.
NODE_STYLE = {"employee": ("#ff4d4f", 18), "account": ("#1890ff", 14), "counterparty": ("#faad14", 10)}
