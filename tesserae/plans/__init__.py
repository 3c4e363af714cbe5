"""What several operators need of the cluster: staged tables and size-checked broadcasts."""
