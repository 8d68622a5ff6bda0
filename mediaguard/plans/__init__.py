"""Plans: whole jobs put together from functions and operators."""
