"""panelwise: Spark-native analytics for device panel time series."""

from .spec import PanelSpec, catalogue, feature_names

__all__ = ["PanelSpec", "catalogue", "feature_names"]
__version__ = "0.1.0"
