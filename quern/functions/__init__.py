"""Column functions with the semantics of array and frame libraries, inside whole-stage code generation."""
