"""Column expressions and pattern builders."""
