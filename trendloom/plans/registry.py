"""A named query next to the SQL that must give the same rows."""


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return register
