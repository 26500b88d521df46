"""From text to a relational plan: representation, catalog, planners, renderers."""
