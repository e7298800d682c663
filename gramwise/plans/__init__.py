from gramwise.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
