"""What names of the machine-learning libraries mean; rows can be added by plugins."""

from __future__ import annotations

from ..runtime.rules import IMPUTERS, RESAMPLERS, SEARCHES, SELECTORS, STATELESS, TRANSFORMERS

#: kind -> names. A plugin may extend the lists before extraction.
SYMBOLS: dict[str, set[str]] = {
    "transformer": {*TRANSFORMERS, "KernelPCA", "FactorAnalysis", "NMF", "FastICA", "LabelEncoder", "TargetEncoder", "ColumnTransformer", "MinMaxScalerModel", "Normalizer", *STATELESS},
    "stateless": {*STATELESS},
    "imputer": {*IMPUTERS},
    "selector": {*SELECTORS, "SequentialFeatureSelector", "GenericUnivariateSelect"},
    "resampler": {*RESAMPLERS},
    "search": {*SEARCHES},
    "pipeline": {"Pipeline", "make_pipeline", "make_imb_pipeline", "ColumnTransformer", "make_column_transformer"},
    "splitter": {"train_test_split", "randomSplit", "random_split"},
    "cv": {"cross_val_score", "cross_validate", "cross_val_predict", "learning_curve", "validation_curve", "permutation_test_score"},
    "folds": {"KFold", "StratifiedKFold", "ShuffleSplit", "StratifiedShuffleSplit", "RepeatedKFold", "RepeatedStratifiedKFold", "LeaveOneOut"},
    "group_folds": {"GroupKFold", "StratifiedGroupKFold", "GroupShuffleSplit", "LeaveOneGroupOut", "LeavePGroupsOut"},
    "curve": {"precision_recall_curve", "roc_curve", "det_curve"},
    "metric": {"accuracy_score", "f1_score", "precision_score", "recall_score", "roc_auc_score", "log_loss", "mean_squared_error", "mean_absolute_error", "r2_score", "balanced_accuracy_score", "average_precision_score", "brier_score_loss", "matthews_corrcoef", "cohen_kappa_score", "classification_report", "root_mean_squared_error"},
    "seeded": {"train_test_split", "RandomForestClassifier", "RandomForestRegressor", "ExtraTreesClassifier", "ExtraTreesRegressor", "GradientBoostingClassifier", "GradientBoostingRegressor", "DecisionTreeClassifier", "DecisionTreeRegressor", "SGDClassifier", "SGDRegressor", "MLPClassifier", "MLPRegressor", "KMeans", "MiniBatchKMeans", "RandomizedSearchCV", "ShuffleSplit", "StratifiedShuffleSplit", "XGBClassifier", "XGBRegressor", "LGBMClassifier", "LGBMRegressor", *RESAMPLERS},
    #: Seeded only under a setting.
    "seeded_if": {"KFold", "StratifiedKFold", "LogisticRegression", "SVC"},
}
GROUP_HINTS = ("patient", "subject", "group", "groups", "user", "customer", "household", "session", "family", "donor")
TIME_HINTS = ("date", "datetime", "timestamp", "time", "year", "month", "week", "day")
TARGET_HINTS = ("target", "label", "y", "outcome")


def kinds_of(name: str | None) -> list[str]:
    return sorted(k for k, v in SYMBOLS.items() if name in v) if name else []
