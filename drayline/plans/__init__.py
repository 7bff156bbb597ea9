"""What a load should do: type rules, column mappings, dry runs, whole loads."""
