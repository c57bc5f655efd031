"""The registered queries by subject."""

from . import catalogue_plans, cloud_plans, file_plans, grid_plans, lattice_plans, polygon_plans, selection_plans, service_plans, spatial_plans, tree_plans  # noqa: F401
