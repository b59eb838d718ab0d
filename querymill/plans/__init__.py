"""Plans that run candidate statements: validation, repair, generation, the engine."""
