"""Account snapshot -> model frame: clean (C1-C3), features (F1-F7), one-hot."""

from __future__ import annotations

from pyspark.sql import DataFrame

from churnkit.operators.clean import MULTI_COLUMNS, Vocabulary, clean_accounts, fit_vocabulary, one_hot
from churnkit.operators.features import TENURE_LABELS, snapshot_features

# Continuous columns the reference standardises.
SCALE_COLUMNS = ["tenure", "MonthlyCharges", "TotalCharges", "AvgMonthlySpend", "ChargeIncrease",
                 "NumServices"]
ID = "customerID"
LABEL = "Churn"


def fit_account_vocabulary(featured: DataFrame) -> Vocabulary:
    """Sorted categories per column (first dropped); tenure groups keep bin order."""
    vocab = fit_vocabulary(featured, MULTI_COLUMNS)
    if "TenureGroup" in featured.columns:
        vocab.kept["TenureGroup"] = list(TENURE_LABELS[1:])
    return vocab


def featurize_accounts(accounts: DataFrame, variant: str = "training") -> DataFrame:
    """Cleaned snapshot plus engineered features, categories still text."""
    return snapshot_features(clean_accounts(accounts), variant)


def encode_accounts(accounts: DataFrame, vocab: Vocabulary | None = None,
                    variant: str = "training") -> tuple[DataFrame, Vocabulary]:
    """Model frame of the snapshot; the vocabulary is fitted here unless given."""
    featured = featurize_accounts(accounts, variant)
    vocab = vocab or fit_account_vocabulary(featured)
    return one_hot(featured, vocab), vocab


def feature_columns(encoded: DataFrame) -> list[str]:
    """Every column except the id and the label."""
    return [c for c in encoded.columns if c not in (ID, LABEL)]
