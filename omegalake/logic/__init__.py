"""Small per-formula helpers that the Arrow functions of ``omegalake.functions`` call."""
