"""Hyper-parameters per model family."""

# Tuned settings of the three families. ``LGBM`` settings of leaf-wise growth have no
# counterpart in Spark's boosted trees and are left out.
HYPERPARAMETERS = {
    "LR": {},
    "RF": {
        "max_depth": 20,
        "max_features": "sqrt",
        "min_samples_leaf": 8,
        "n_estimators": 28,
        "bootstrap": True,
    },
    "LGBM": {
        "bagging_fraction": 0.6,
        "feature_fraction": 0.6,
        "max_bin": 255,
        "max_depth": 3,
        "min_data_in_leaf": 50,
        "n_estimators": 100,
    },
}
SEED = 42
FAMILIES = ("LR", "RF", "LGBM")


def forest_params(params: dict) -> dict:
    """``cacheNodeIds``: a pass over the rows goes on from the node each row has reached in each tree. Otherwise every pass
    sends the trees to all tasks and leads every row down from the root again. The model is the same."""
    return {
        "cacheNodeIds": True,
        "numTrees": params.get("n_estimators", 100),
        "maxDepth": params["max_depth"],
        "featureSubsetStrategy": str(params.get("max_features", "auto")),
        "minInstancesPerNode": params.get("min_samples_leaf", 1),
        "bootstrap": params.get("bootstrap", True),
        "seed": params.get("random_state", SEED),
    }


def boosting_params(params: dict) -> dict:
    return {
        "maxIter": params.get("n_estimators", 100),
        "maxDepth": params["max_depth"],
        "subsamplingRate": params.get("bagging_fraction", 1.0),
        "featureSubsetStrategy": str(params.get("feature_fraction", "all")),
        "maxBins": params.get("max_bin", 255),
        "minInstancesPerNode": params.get("min_data_in_leaf", 20),
        "seed": params.get("random_state", SEED),
    }
