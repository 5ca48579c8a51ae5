"""Analytics as DataFrame operators; every one keeps match_id as its leading key."""
