"""Survey-shaped views, reports and the registered queries."""
