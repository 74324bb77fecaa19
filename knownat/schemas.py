"""Canonical columns and the parameters a desk may change."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Canonical columns of the published tables.
DAILY_MARKET_COLUMNS = [
    "trade_date", "code", "name", "market", "segment", "open", "high", "low", "close",
    "volume", "amount", "marcap", "listed_shares",
]
LIFECYCLE_COLUMNS = [
    "dataset", "raw_version_id", "source_row_number", "observed_at", "standard_code", "short_code", "name",
    "market", "security_type", "stock_type", "listing_date", "last_trading_date", "delisting_date",
    "issuer_reference", "event_type", "effective_date", "previous_code", "previous_name", "previous_market",
    "successor_standard_code",
]
STATUS_COLUMNS = [
    "dataset", "requested_date", "raw_version_id", "source_row_number", "observed_at", "standard_code",
    "short_code", "name", "market", "security_kind", "management_designation", "trading_suspension",
    "liquidation_trading", "effective_date", "published_at",
]

# Source headers of the official files.
DAILY_MARKET_API = {
    "basDt": "trade_date", "srtnCd": "code", "itmsNm": "name", "mrktCtg": "market", "mkp": "open",
    "hipr": "high", "lopr": "low", "clpr": "close", "trqu": "volume", "trPrc": "amount",
    "mrktTotAmt": "marcap", "lstgStCnt": "listed_shares",
}
DAILY_MARKET_CSV = {
    "기준일자": "trade_date", "종목코드": "code", "단축코드": "code", "종목명": "name", "시장구분": "market",
    "소속부": "segment", "시가": "open", "고가": "high", "저가": "low", "종가": "close", "거래량": "volume",
    "거래대금": "amount", "시가총액": "marcap", "상장주식수": "listed_shares",
}
LIFECYCLE_HEADERS = {
    "표준코드": "standard_code", "ISU_CD": "standard_code", "StandardCode": "standard_code",
    "단축코드": "short_code", "종목코드": "short_code", "ISU_SRT_CD": "short_code",
    "한글 종목명": "name", "한글종목명": "name", "종목명": "name", "ISU_NM": "name",
    "시장구분": "market", "MKT_NM": "market", "증권구분": "security_type", "SECUGRP_NM": "security_type",
    "주식종류": "stock_type", "KIND_STKCERT_TP_NM": "stock_type", "상장일": "listing_date",
    "LIST_DD": "listing_date", "최종매매일": "last_trading_date", "ARRANTRD_END_DD": "last_trading_date",
    "폐지일": "delisting_date", "상장폐지일": "delisting_date", "DELIST_DD": "delisting_date",
    "회사코드": "issuer_reference", "법인코드": "issuer_reference", "변경구분": "event_type",
    "변경일": "effective_date", "이전종목코드": "previous_code", "이전종목명": "previous_name",
    "이전시장": "previous_market", "승계표준코드": "successor_standard_code",
}
STATUS_HEADERS = {
    "기준일": "requested_date", "BAS_DD": "requested_date", "basDt": "requested_date",
    "표준코드": "standard_code", "ISU_CD": "standard_code", "단축코드": "short_code", "종목코드": "short_code",
    "ISU_SRT_CD": "short_code", "종목명": "name", "한글 종목명": "name", "ISU_NM": "name",
    "시장구분": "market", "MKT_NM": "market", "주식종류": "security_kind", "KIND_STKCERT_TP_NM": "security_kind",
    "관리종목여부": "management_designation", "MANG_ITEM_YN": "management_designation",
    "거래정지여부": "trading_suspension", "TRD_STOP_YN": "trading_suspension",
    "정리매매여부": "liquidation_trading", "CLSG_TRD_YN": "liquidation_trading",
    "적용일": "effective_date", "EFFECTIVE_DD": "effective_date", "공시일시": "published_at",
    "PUBLISHED_AT": "published_at",
}
# Event type of a lifecycle row that names none, by dataset.
DEFAULT_EVENTS = {
    "security_master": "listing", "new_listings": "listing", "delistings": "delisting",
    "identifier_changes": "identifier_change",
}
SUPPORTED_EVENTS = ["listing", "identifier_change", "name_change", "market_transfer", "delisting"]
LIFECYCLE_DATASETS = ["delistings", "identifier_changes", "new_listings", "security_master"]

# Allowed steps of a day in the ingest log.
TRANSITIONS = {
    "pending": ["downloading"],
    "downloading": ["downloaded", "failed", "calendar_unresolved"],
    "downloaded": ["parsed", "failed", "quarantined", "calendar_unresolved"],
    "parsed": ["validated", "failed", "quarantined"],
    "validated": ["promoted", "quarantined", "failed"],
    "failed": ["downloading"],
    "quarantined": ["downloading"],
    "calendar_unresolved": ["downloading", "non_session"],
    "non_session": ["downloading"],
    "promoted": ["quarantined"],
}
STATES = list(TRANSITIONS)
MARKETS = ("KOSPI", "KOSDAQ")
# Fixed value: names left out of the candidate universe.
EXCLUDED_NAMES = r"(?i)(우$|우B$|스팩|리츠|REIT)"
FACTORS = ("momentum", "value", "quality", "volatility")

ACCOUNT_SCHEMA = T.StructType(
    [
        T.StructField("stock", T.StringType()), T.StructField("year", T.IntegerType()),
        T.StructField("basis", T.StringType()), T.StructField("receipt", T.StringType()),
        T.StructField("filed_at", T.DateType()), T.StructField("corp_code", T.StringType()),
        T.StructField("account_id", T.StringType()), T.StructField("sj_div", T.StringType()),
        T.StructField("thstrm_amount", T.StringType()), T.StructField("frmtrm_amount", T.StringType()),
        T.StructField("currency", T.StringType()),
    ]
)


@dataclass(frozen=True)
class RankingRules:
    markets: tuple[str, ...] = MARKETS
    excluded_names: str = EXCLUDED_NAMES
    limit: int = 100
    history: int = 252
    weights: dict[str, float] = field(
        default_factory=lambda: {"momentum": 45, "value": 20, "quality": 20, "volatility": 15}
    )
    min_marcap: float = 1e11
    min_turnover: float = 1e9
    minimum_ready: int = 80

    def __post_init__(self):
        if set(self.weights) != set(FACTORS) or min(self.weights.values()) < 0 or sum(self.weights.values()) != 100:
            raise ValueError("weights must name the four factors, be non-negative and sum to 100")
        if self.history < 2 or not 1 <= self.minimum_ready <= 100 or self.limit < 1:
            raise ValueError("history must be at least 2, minimum_ready within 1..100, limit positive")


@dataclass(frozen=True)
class TradingRules:
    targets: int = 20
    keep_rank: int = 30
    slots: int = 20
    min_trade: float = 100_000
    fee: float = 0.003
    tax: float = 0.0
    slippage: float = 0.0

    def __post_init__(self):
        if self.targets < 0 or self.keep_rank < 0 or self.min_trade < 0:
            raise ValueError("targets, keep_rank and min_trade must not be negative")
        if any(not 0 <= rate < 1 for rate in (self.fee, self.tax, self.slippage)):
            raise ValueError("cost rates must lie in [0, 1)")


@dataclass(frozen=True)
class RunConfig:
    start: str
    end: str
    initial_cash: float = 10_000_000
    ranking: RankingRules = field(default_factory=RankingRules)
    trading: TradingRules = field(default_factory=TradingRules)

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError("start must not be later than end")
        if self.initial_cash <= 0:
            raise ValueError("initial cash must be positive")


@dataclass(frozen=True)
class Policy:
    policy_id: str = "investability-v1"
    version: str = "1.0.0"
    allowed_markets: tuple[str, ...] = MARKETS
    allowed_security_kinds: tuple[str, ...] = ("common",)
    blocking_flags: tuple[str, ...] = ("management_designation", "trading_suspension", "liquidation_trading")
