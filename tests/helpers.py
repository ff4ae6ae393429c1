def same_rows(frame, connection, sql):
    """Rows of a Spark query and of DuckDB SQL, columns by name, floats to 6 places."""

    def rows(table):
        names = sorted(table.column_names)
        show = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
        return names, sorted(tuple(show(r[n]) for n in names) for r in table.to_pylist())

    return rows(frame.toArrow()), rows(connection.sql(sql).to_arrow_table())
