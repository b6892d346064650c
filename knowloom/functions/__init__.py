"""Column expressions (Column -> Column) that stay inside whole-stage codegen."""
