"""Schemas of the compliance tables and of the records that flow between the operators, as DDL: readers and createDataFrame take them as they are."""

from __future__ import annotations

COMPLIANCE_ENTRIES = "id int, address string, chain string, source string, entity_name string, reason string, added_at timestamp, last_seen timestamp"
USERS = "id int, thor_address string, first_seen timestamp, last_seen timestamp, screened_at timestamp, l1_fetched_at timestamp, flagged boolean, flag_reason string"
L1_ADDRESSES = "id int, thor_address string, l1_address string, chain string, pool string, affiliate boolean, discovered_at timestamp"
SYNC_LOG = "id int, type string, status string, records_processed int, flags_found int, error string, duration int, created_at timestamp"
TRANSACTIONS = "id int, tx_hash string, block_height int, memo string, memo_type string, from_address string, to_address string, asset string, amount string, chain string, timestamp timestamp, processed boolean"
CERTIFICATES = "id int, cert_id string, address string, flagged boolean, sources_checked int, issued_at timestamp"
REPORTS = "id int, report_id string, address string, date_from timestamp, date_to timestamp, include_new boolean, reveal_wallet boolean, tx_count int, tx_data string, created_at timestamp"
MANUAL_FLAGS = "id int, address string, chain string, reason string, added_by string, added_at timestamp, active boolean"
PRIVACY_SNAPSHOTS = (
    "id int, tvl_usd string, wallet_count int, revenue_usd string, cumulative_fees_usd string, cumulative_fees_assets array<struct<asset:string,amount:double>>, "
    "cumulative_volume_usd string, cumulative_volume_assets array<struct<asset:string,amount:double>>, created_at timestamp"
)

_LEG = "array<struct<address:string,txID:string,coins:array<struct<asset:string,amount:string>>>>"
_FEES = "networkFees:array<struct<asset:string,amount:string>>,liquidityFee:string"
ACTIONS = (
    f"date string, type string, status string, `in` {_LEG}, `out` {_LEG}, metadata struct<contract:struct<contractType:string,funds:string,attributes:map<string,string>>,"
    f"swap:struct<{_FEES},isStreamingSwap:boolean>,addLiquidity:struct<{_FEES}>,withdraw:struct<{_FEES}>>"
)
BALANCES = "denom string, amount string"
POOLS = "asset string, assetPrice string, assetPriceUSD string"
_EVENTS = "array<struct<type:string,attributes:array<struct<key:string,value:string>>>>"
COSMOS_TXS = f"txhash string, events {_EVENTS}, logs array<struct<events:{_EVENTS}>>"
EVM_LOGS = "data string"
TRON_EVENTS = "result struct<_user:string,user:string>"
HISTORY = (
    "seq bigint, type string, date string, assetIn string, amountIn string, assetOut string, amountOut string, rawAmountIn string, rawAmountOut string, `from` string, `to` string, fromLabel string, toLabel string, "
    "txID string, status string, feeAmount string, feeCurrency string, contractName string, contractCategory string"
)
CONTRACTS = "address string, category string, product string, name string, role string"
